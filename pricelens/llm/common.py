"""Column pieces and small helpers the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.session import staged

#: what stands between words of visible characters: ASCII white space
SPACED = r"[\x20\x09-\x0D]+"
#: what stands between words of lower-case ASCII letters, digits and everything beyond ASCII
ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case text for comparison with ASCII words.

    The Kelvin sign is the one character beyond ASCII that ``lower`` turns into
    an ASCII letter as a whole; it is exchanged for another such character.
    """
    return F.lower(F.replace(text, F.lit("K"), F.lit("Å")))


def words(text: Column, between: str) -> Column:
    """All words of a text as an array; null counts as empty.  Splitting costs a
    third of extracting match by match."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), between, -1), "")


def text_key(text: Column) -> Column:
    """Together with the document's id, this names a row by its content, so a
    second scan of the same rows meets the first one again."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equality on all named columns, null equal to null."""
    condition = F.lit(True)
    for n in names:
        condition = condition & left[n].eqNullSafe(right[n])
    return condition


def row_key(id_value: Column, text: Column) -> Column:
    """One hash of a row's id and text; rows alike in both share it."""
    return F.xxhash64(id_value, id_value.isNull(), F.coalesce(text, F.lit("")), text.isNull())


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file; executors have the same installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Spark drops a query's shuffle files when it ends, where this is set
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """As ``session.staged``, and the shuffle files behind the table go once it is
    written: nothing reads them again, and they would fill the disks until the driver
    collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_DROP_SHUFFLES, "false")
    conf.set(_DROP_SHUFFLES, "true")
    try:
        return staged(df)
    finally:
        conf.set(_DROP_SHUFFLES, before)
