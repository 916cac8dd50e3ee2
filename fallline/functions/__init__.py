"""Functions over columns: no function here reads data or starts a job."""
