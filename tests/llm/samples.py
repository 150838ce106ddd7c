"""Small tables with the cases that every operator must handle."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my nu xi omikron pi rho sigma tau".split()


def prose(seed, n):
    """Words in a fixed but varied order."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 97))
    return " ".join(out)


SCHEMA = T.StructType([
    T.StructField(c, T.StringType() if c not in ("doc_id", "n_chars") else T.LongType())
    for c in ("doc_id", "text", "lang", "source", "n_chars")
])


def documents(spark, rows, **more):
    """A documents table from (doc_id, text, source); ``more`` adds columns of one value."""
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)
    return df.withColumns({k: F.lit(v) for k, v in more.items()}) if more else df


# Names that operators use inside.
CLASHES = {
    c: "x"
    for c in (
        "body row score may d tie n bits node key g c h b w k place slot block kind gone_id host kept copy "
        "repeat_spans of_d of_tie edited sequence_id epoch title labels word shingle held_out mix_id mix_text"
    ).split()
}


def odd_documents(spark):
    """Nulls in every column, empty, blank, long and repeated texts, ties, and names that clash."""
    long = prose(3, 4000)
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, prose(1, 80), "a"), (5, prose(1, 80), "b"), (6, prose(2, 80), None),
        (None, prose(4, 60), "a"), (None, prose(4, 60), "a"), (7, long, "a"), (7, long, "a"), (8, "one", "b"), (9, "ä ö\n\nü ß", "b"),
        (10, prose(1, 79) + " changed", "a"), (11, "x" * 300, "c"), (None, None, None),
    ]
    return documents(spark, rows, **CLASHES)
