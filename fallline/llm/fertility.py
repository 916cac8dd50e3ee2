"""Quality rules: how well a public tokenizer fits a text.

A text is rejected by plain counts (too few words, too much repetition) or because its fertility
leaves the band of its language: characters per token, the share of tokens that are only part of a
character, and the entropy of the tokens. The bounds hang on the number of tokens ``n``: the fewer there
are, the wider they are, by ``SLACK / sqrt(n)``, and the entropy need not come closer than ``REACH`` to
the most that n tokens can have, log2(n). No text is too short to be judged.

A run of white space longer than ``RUN`` is tokenized in parts of that length, since the tokenizer's pattern
cannot match longer ones; nothing else is cut.

Whole texts are read, one row gives one row, and nothing is shuffled. A null text counts as empty;
an empty text has no words and fails. Repeated rows are judged alike. An unknown or null language
takes the band of its script.
"""

import base64
import re
from dataclasses import dataclass
from functools import lru_cache
from math import log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import text as T

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MIN_WORDS, MAX_REPEATED = 10, 20
#: How much wider the bounds of short texts are, and the share of log2(n) that their entropy must reach.
SLACK, REACH = 2.0, 0.8
#: Longest run of white space that is tokenized in one go.
RUN = 1000
_LONG_SPACE = re.compile(r"\s{%d,}" % (RUN + 1))


@dataclass(frozen=True)
class Band:
    """Bounds of an accepted text."""

    least_chars: float
    most_chars: float
    most_fallback: float
    least_entropy: float


#: Set around the figures of texts that are marked as good, with a margin on every side.
LANGUAGES = {
    "de": Band(2.30, 3.15, 0.08, 5.2),
    "en": Band(2.20, 3.10, 0.03, 5.2),
    "es": Band(2.15, 2.75, 0.05, 5.2),
    "fr": Band(2.00, 2.75, 0.05, 5.2),
}
SCRIPTS = {"latin": Band(1.7, 6.0, 0.15, 4.0), "other": Band(0.4, 6.0, 0.90, 3.0)}


@lru_cache(maxsize=4)
def _encoder(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    part = np.zeros(max(table.values()) + 1, dtype=bool)
    for piece, at in table.items():
        try:
            piece.decode()
        except UnicodeDecodeError:
            part[at] = True
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return own, part


def _pieces(text: str) -> list[str]:
    """The text, cut only within runs of white space longer than RUN; the last space stays with its word."""
    out, at = [], 0
    for m in _LONG_SPACE.finditer(text):
        end = m.end() - (m.end() < len(text))
        out += [text[at : m.start()], *(text[k : min(k + RUN, end)] for k in range(m.start(), end, RUN))]
        at = end
    return [x for x in [*out, text[at:]] if x]


def tokens_of(ranks: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of a text, and for each id whether it is only part of a character."""
    own, part = _encoder(ranks)
    parts = [own.encode_to_numpy(x) for x in _pieces(text)]
    return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), part


def fertility(ranks: bytes, text: str) -> tuple[int, float, float, float]:
    """Tokens, characters per token, share of partial characters, entropy in bits."""
    tokens, part = tokens_of(ranks, text)
    if not len(tokens):
        return 0, 0.0, 0.0, 0.0
    counts = np.bincount(tokens)
    share = counts[counts > 0] / len(tokens)
    return (
        len(tokens),
        len(text) / len(tokens),
        float(part[tokens].mean()),
        float(-(share * np.log2(share)).sum()) + 0.0,
    )


def band_of(lang: str | None, text: str) -> Band:
    if lang in LANGUAGES:
        return LANGUAGES[lang]
    latin = sum(c.isascii() or "À" <= c <= "ɏ" for c in text)
    return SCRIPTS["latin" if 2 * latin >= len(text) else "other"]


def within(band: Band, figures: tuple[int, float, float, float]) -> bool:
    n, chars, fallback, entropy = figures
    if not n:
        return False
    slack = SLACK / sqrt(n)
    return (
        band.least_chars * (1 - slack) <= chars <= band.most_chars * (1 + slack)
        and fallback <= band.most_fallback + slack / 4
        and entropy >= min(band.least_entropy, REACH * log2(n))
    )


def counts(data: bytes, n_chars: int, words: np.ndarray) -> tuple[int, int, int, int, int, bool]:
    """Words, characters in them, symbols, repeated lines, repeated words, and the plain verdict."""
    spaces = len(data) - len(data.translate(None, b" \t\n\r\x0b\x0c"))
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) > T.WORDS:
        found = T.windows(words)
        _, back, times = np.unique(found, return_inverse=True, return_counts=True)
        again = times[back] > 1
        if again.any():
            covered = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(covered, np.flatnonzero(again), 1)
            np.add.at(covered, np.flatnonzero(again) + T.WORDS, -1)
            repeated = int((np.cumsum(covered) > 0).sum())
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEATED * len(words)
    return len(words), n_chars - spaces, symbols, len(lines) - len(set(lines)), repeated, failed


def _judged(ranks: bytes, texts: pa.Array, langs: pa.Array):
    data, langs = T.bytes_of(texts), langs.to_pylist()
    for at, words in T.texts_words(data):
        text = data[at].decode()
        base = counts(data[at], len(text), words)
        figures = fertility(ranks, text)
        yield at, base, figures, not base[-1] and within(band_of(langs[at], text), figures)


SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean, n_tokens bigint, "
    "chars_per_token double, fallback_share double, token_entropy double"
)


def _ranks(spark: SparkSession, vocabulary: str):
    with open(vocabulary, "rb") as file:  # on the driver; tasks get its bytes, about 1 MB
        return spark.sparkContext.broadcast(file.read())


def judge(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Counts, fertility and verdict of every row."""
    ranks = _ranks(docs.sparkSession, vocabulary)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [None] * batch.num_rows
        for at, base, figures, kept in _judged(ranks.value, batch.column(1), batch.column(2)):
            rows[at] = (*base, kept, *figures)
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] + [pa.float64()] * 3
        columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names)

    picked = docs.select(T.ids(doc_id), T.ids(text, "text"), T.ids(lang, "lang"))
    return T.map_batches(picked, work, SCHEMA)


def passing(
    docs: DataFrame, text: str = "text", lang: str = "lang", vocabulary: str = VOCABULARY
) -> DataFrame:
    """The rows that :func:`judge` keeps, with all their columns."""
    ranks = _ranks(docs.sparkSession, vocabulary)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(batch.num_rows, dtype=bool)
        langs = batch.column(batch.schema.get_field_index(lang))
        texts = batch.column(batch.schema.get_field_index(text))
        for at, _, _, kept in _judged(ranks.value, texts, langs):
            keep[at] = kept
        return batch.filter(pa.array(keep))

    return T.map_batches(docs, work, docs.schema)
