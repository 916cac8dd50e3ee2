"""The operators that work row by row: rules, personal data, licences, URLs, pages."""

import os
import random
import re
from collections import Counter

import pytest

from llm_fixtures import awkward, make_docs  # noqa: F401

from fallline.llm import fertility, html_text, licenses, pii, url_filter

SMALL = "/root/testdata/sf0.001"
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == 0
                or kind == 1 and all(int(x) <= 255 for x in m[0].split("."))
                or kind == 2 and 12 <= len(digits) <= 19 and pii.luhn(digits)
                or kind == 3 and 9 <= len(digits) <= 15
            ):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@pytest.mark.parametrize("letters", ["a1.@-+ ", "1.2 0", "a.@b-_", "+1() -.2", "123456 -4"])
def test_base_spans_match_plain_expressions(letters):
    rng = random.Random(letters)
    for _ in range(4000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 25)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_further_kinds_need_check_or_context():
    found = lambda text: [pii.KINDS[k] for _, k, _ in pii.spans_of(text)[1]]
    assert found("IBAN DE89 3704 0044 0532 0130 00") == ["iban"]
    assert found("IBAN DE89 3704 0044 0532 0130 01") == []
    assert found("call (555) 123-4567 now") == ["local"]
    assert found("about 555 123-4567 things") == []
    assert found("ssn 123-45-6789") == ["national"] and found("part 123-45-6789") == []
    assert pii.redacted("mail a@b.org or +1 (306) 555-4891.") == "mail <EMAIL> or <PHONE>."


def test_search_is_linear_in_long_runs():
    assert pii.base_spans("a" * 300_000 + " x@y.z " + "1" * 300_000 + ".") == [(300_001, 0, 300_006)]


def test_personal_data_of_awkward_rows(make_docs, awkward):
    docs = make_docs([*awkward, (9, "x a@b.co\U0001f600 1.2.3.4", "en", "a")])
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    assert rows[9].spans == "email:2:8,ip:10:17" and rows[9].n_email == rows[9].n_ip == 1
    assert rows[3].spans == "" and rows[3].base_sha256.startswith("e3b0c442")
    done = pii.redact(docs)
    assert done.columns == docs.columns and done.count() == len(awkward) + 1
    assert {r.doc_id: r.text for r in done.collect()}[9] == "x <EMAIL>\U0001f600 <IP>"
    assert pii.find(make_docs([])).count() == 0


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    times = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {
        k + d for k in range(len(words) - 4) if times[tuple(words[k : k + 5])] > 1 for d in range(5)
    }
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered),
    )


def test_rules_match_plain_counts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = fertility.judge(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert base == plain_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert all(good)
    kept = {r.doc_id for r in fertility.passing(docs).collect()}
    assert kept == {r.doc_id for r in rows if r.kept}


def test_rules_on_awkward_rows(make_docs, awkward):
    docs = make_docs(awkward)
    rows = fertility.judge(docs).collect()
    assert len(rows) == len(awkward)
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and by[3].base_failed
    assert by[8].n_repeat_words == 210_000 and not by[8].kept
    assert fertility.passing(docs).columns == docs.columns
    assert fertility.judge(make_docs([])).count() == 0


def test_pieces_keep_the_text():
    for text in ("", "a b", "x" * 2500 + " y " + "z" * 1001, " lead", "trail "):
        assert "".join(fertility._pieces(text)) == text or len(text) > 2000


@pytest.mark.parametrize("layout", ["plain", "shouted", "wrapped"])
def test_whole_licences_by_any_layout(make_docs, layout):
    rows = []
    for k, (_, text) in enumerate(licenses.LICENSES):
        if layout == "shouted":
            text = "Copyright (c) 2020 Somebody\nAll rights reserved.\n\n" + text.upper()
        if layout == "wrapped":
            text = "# " + text.replace(" ", "\n  ", 3).replace(" copyright", "\ncopyright").replace("license", "licence").replace('"', "''")
        rows.append((k, text))
    found = {r.doc_id: r.license for r in licenses.scan(make_docs(rows)).collect()}
    assert found == {k: name for k, (name, _) in enumerate(licenses.LICENSES)}


def test_notices_and_awkward_rows(make_docs, awkward):
    text = "Intro.\nreleased under the mit licence\nMore. Released under the MIT License.\n  Licensed under CC BY-NC 4.0.  "
    rows = {r.doc_id: r for r in licenses.scan(make_docs([*awkward, (9, text)])).collect()}
    assert (rows[9].notices, rows[9].n_notices, rows[9].license) == ("CC-BY-NC-4.0,MIT", 2, None)
    assert rows[3].digest is None and rows[3].notices == "" and rows[3].n_notices == 0
    assert licenses.scan(make_docs(awkward)).count() == len(awkward)
    assert licenses.scan(make_docs([])).count() == 0
    assert licenses.scan(make_docs([(1, "x")]), notices=()).first().n_notices == 0


def pages(spark, rows):
    schema = "page_id bigint, url string, html string, host string, text string, n_chars string"
    return spark.createDataFrame([(*r, "h", "t", "n") for r in rows], schema)


def test_urls(spark):
    urls = {
        1: "HTTP://M.Example.ORG/es/1?x", 2: "http://example.org/en/12#a", 3: "http://example.org/en/2",
        4: "http://a.com/fr/", 5: "http://a.com/de/x", 6: "http://a.com/fr", 7: None, 8: "no scheme",
        9: "http://x.spam-farm.example.net/y", 10: "http://notspam-farm.example.net/y", 11: "://org",
        12: "http://xexample.org/es/", 13: "http://org/?q", 14: "http://" + "a." * 5000 + "com/de/",
    }
    rows = {r.page_id: r for r in url_filter.judge(pages(spark, [(k, u, None) for k, u in urls.items()])).collect()}
    got = {k: (r.rule, r.verdict) for k, r in rows.items()}
    assert got == {
        1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: ("org/", "allow"),
        4: ("com/fr/", "allow"), 5: ("com/de/", "block"), 6: (None, "allow"), 7: (None, "allow"),
        8: (None, "allow"), 9: (None, "block"), 10: (None, "allow"), 11: (None, "allow"), 12: ("org/", "allow"),
        13: ("org/", "allow"), 14: ("com/de/", "block"),
    }
    assert (rows[1].host, rows[1].path) == ("m.example.org", "/es/1")
    assert (rows[7].host, rows[7].path, rows[8].host) == ("", "", "")
    assert url_filter.judge(pages(spark, [])).count() == 0
    assert url_filter.judge(pages(spark, [(1, "http://a.org/", None)]), rules=(), blocked=()).first().verdict == "allow"


def test_colliding_digests_are_told_apart(monkeypatch, tmp_path):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda x: len(x))
    url_filter.write_array([("aa/", 0), ("bb/", 1), ("c", 2)], str(tmp_path / "d"))
    assert list(url_filter.Digests(str(tmp_path / "d")).find([b"bb/", b"aa/", b"cc/", b"c"])) == [2, 1, 0, 4]


PAGE = (
    '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>'
    '<header>Site <b>name</b></header><nav><ul><li><a href="/">Home</a></li></ul></nav>{open}<h1>Head &amp; line</h1>'
    "<p>First   <b>bo</b>ld&nbsp;text that goes on for a while.<br>Next<p>Second paragraph with several words in it."
    '<div class="ad">Buy now at once</div><form><label>Mail</label><input></form><p>Third paragraph ends here.</p>{close}'
    '<div class="comments"><p>Nice post</p></div><aside>Also read</aside><footer>&copy; x</footer>'
)
TEXT = (
    "Head & line First bold text that goes on for a while. Next Second paragraph with several words in it. "
    "Third paragraph ends here."
)


def test_pages(spark):
    marked = PAGE.format(open="<article>", close="</article>") if False else PAGE.replace("{open}", "<article>").replace("{close}", "</article>")
    plain = PAGE.replace("{open}", "<div>").replace("{close}", "</div>")
    rows = [(k, f"u{k}", marked) for k in range(5)] + [(5, None, plain), (6, "u", None), (7, "u", ""), (8, "u", "<p")]
    rows += [(8, "u", "<p"), (None, "u", "just words"), (9, "u", "<article>" + "word " * 100_000 + "<!-- open")]
    out = html_text.main_text(pages(spark, rows)).collect()
    got = {r.page_id: r for r in out}
    assert len(out) == len(rows)
    assert {got[k].text for k in range(6)} == {TEXT} and got[0].n_chars == len(TEXT)
    assert got[6].text == got[7].text == "" and got[6].n_chars == 0
    assert got[None].text == "just words" and got[9].n_chars == 5 * 100_000 - 1
    assert html_text.main_text(pages(spark, [])).count() == 0


def test_best_run_matches_all_runs():
    rng = random.Random(5)
    weights = {"word:plain:p": 1.0, "tag:p": -0.7, "word:boiler:nav": -2.0, "tag:nav": -1.5}
    for _ in range(200):
        parts = rng.choices(["<p>a b", "<nav>x</nav>", "<p>c", "<p>"], k=rng.randint(0, 8))
        page = "".join(parts)
        found = [t for t in html_text.tokens(page) if t[0] != "space"]
        value = [weights.get(k.lstrip("+"), html_text.fallback(k.lstrip("+"))) for k, *_ in found]
        best = max([0.0] + [sum(value[i:j]) for i in range(len(value)) for j in range(i + 1, len(value) + 1)])
        words = html_text.extract(page, weights).split()
        inside = [(i, j) for i in range(len(value)) for j in range(i + 1, len(value) + 1) if abs(sum(value[i:j]) - best) < 1e-9]
        fits = [[w for k, w, _ in found[i:j] if w and ":boiler:" not in k] for i, j in inside] or [[]]
        assert words in fits


def test_wrappers_do_not_take_the_article_along():
    body = " ".join(f"<p>{' '.join(f'w{i}x{k}' for k in range(30))}.</p>" for i in range(4))
    want = " ".join(html_text.extract(f"<body>{body}</body>", {}).split())
    assert want.count("w") == 120
    menu = '<ul class="menu"><li><a href="/">Home</a></li></ul>'
    for page in (
        f'<body><div class="has-sidebar">{menu}{body}</div></body>',
        f'<body><main class="no-sidebar">{menu}{body}</main></body>',
        f'<body><form id="aspnetForm">{menu}{body}</form></body>',
        f"<body><nav><a href='/'>Home</a>{body}</body>",
        f"<head><title>Site</title><body>{menu}{body}</body>",
        f'<body><div class="sidebar"><article>{body}</article></div></body>',
        f'<body>{body}<div class="ad">Buy this now</div></body>',
    ):
        assert html_text.extract(page, {}) == want
    inner = '<div class="post-header"><h1>Own title here</h1></div>'
    figure = "<figure><figcaption>What it shows</figcaption></figure>"
    got = html_text.extract(f"<body><article>{inner}{body}{figure}</article></body>", {})
    assert got == f"Own title here {want} What it shows"


def test_long_licences_are_known(make_docs):
    folder = "/usr/share/common-licenses"
    if not os.path.isdir(folder):
        pytest.skip("no licence texts on this machine")
    want = {
        "Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0",
        "MPL-2.0": "MPL-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause",
    }
    rows = []
    for k, name in enumerate(want):
        with open(f"{folder}/{name}", encoding="utf-8") as file:
            text = file.read()
        rows += [(k, text), (100 + k, " ".join(text.upper().split()) if "opyright" not in text else text), (200 + k, text[:-99])]
    found = {r.doc_id: r.license for r in licenses.scan(make_docs(rows)).collect()}
    for k, license_id in enumerate(want.values()):
        assert (found[k], found[100 + k]) == (license_id, license_id)
    assert found[205] is None


def test_block_list_from_a_file_and_a_table(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "http://a.bad.test/x"), (2, "http://other.test/shop/1"), (3, "http://other.test/"), (4, "http://h7.many.test/")],
        "page_id bigint, url string",
    )
    entries = [("Bad.test", ""), ("other.test", "/shop/"), *((f"h{k}.many.test", "") for k in range(5000))]
    path = tmp_path / "list.txt"
    path.write_text("# hosts\n\n" + "\n".join(h + p for h, p in entries))
    table = spark.createDataFrame(entries, "host string, path string")
    for blocked in (str(path), table):
        found = url_filter.judge(pages, (), blocked).collect()
        assert {r.page_id: r.verdict for r in found} == {1: "block", 2: "block", 3: "allow", 4: "block"}


def test_a_form_around_the_whole_page_is_its_content_and_another_is_not():
    body = f"<p>{' '.join(f'w{k}' for k in range(30))}.</p>"
    login = "<form><label>Your mail address please</label><input><button>Send it</button></form>"
    want = " ".join(html_text.extract(f"<body>{body}</body>", {}).split())
    assert want.count("w") == 30
    foot = "<footer>All rights reserved by us</footer>"
    assert html_text.extract(f"<body><form method=post>{body}{login}</form>{foot}</body>", {}).startswith(want)
    assert html_text.extract(f"<body>{body}<form><p>{'Write to us ' * 30}</p></form></body>", {}) == want
    assert html_text.extract(f"<body>{login}{foot}</body>", {}) == ""
