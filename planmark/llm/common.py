"""What several of these operators share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

#: A word: a run of anything but blank and the five ASCII line and tab characters.
WORD = "[^\\x20\\x09-\\x0D]+"


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names that ``df`` does not use yet (Spark resolves names without regard to case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of an Arrow batch where rows hold whole documents.
BATCH = 1_000


def bound_batches(df: DataFrame) -> None:
    """Keep Arrow batches of documents small for the session of ``df``.

    A batch is held several times at once (JVM, worker, results), and the default of 10,000 rows is
    made for narrow rows. A smaller setting of the user stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    now = int(conf.get(key, "10000"))
    if now <= 0 or now > BATCH:
        conf.set(key, str(BATCH))


def text_of(column: str) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def slices(texts: list[str], characters: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of ``texts`` with about so many characters, one text at least."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > characters:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


