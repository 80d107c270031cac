"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from candela.session import scratch_path

# everything that is not a digit, a-z or beyond ASCII, in a text whose letters are lower-cased
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACES = r"[\x20\x09-\x0D]+"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the files: short lineage, true size statistics."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_words(text: Column) -> Column:
    """Words of digits, a-z and non-ASCII characters, lower-cased; null gives no words.

    The Kelvin sign is the only character beyond ASCII that ``lower`` would turn into a plain letter.
    """
    folded = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ſ")))
    return F.array_remove(F.split(folded, SEPARATORS), "")


def spaced_words(text: Column) -> Column:
    """Words between ASCII white space, as written; null gives no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def tail(words: str, skip: int) -> Column:
    """The array without its first ``skip`` elements."""
    return F.slice(F.col(words), skip + 1, F.greatest(F.size(words) - skip, F.lit(0)))


def windows(df: DataFrame, words: str, width: int, keep: Sequence[str]) -> DataFrame:
    """One row per word position: ``pos`` and the words ``w0`` .. ``w{width-1}`` from there (null past the end)."""
    shifted = df.select(*keep, *[(F.col(words) if i == 0 else tail(words, i)).alias(f"w{i}") for i in range(width)])
    rows = shifted.select(*keep, F.posexplode(F.arrays_zip(*[F.col(f"w{i}") for i in range(width)])).alias("pos", "_z"))
    return rows.select(*keep, F.col("pos").cast("long").alias("pos"), *[F.col("_z")[f"w{i}"].alias(f"w{i}") for i in range(width)])


def values(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small fixed table as a local relation."""
    def lit(v) -> str:
        if v is None:
            return "NULL"
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v)

    names = [part.split()[0] for part in schema.split(",")]
    kinds = [part.split()[1] for part in schema.split(",")]
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    df = spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")
    return df.select(*[F.col(n).cast(k).alias(n) for n, k in zip(names, kinds)])


def same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Null-safe equality of columns that both sides have."""
    cond = a[names[0]].eqNullSafe(b[names[0]])
    for n in names[1:]:
        cond = cond & a[n].eqNullSafe(b[n])
    return cond


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``text_key``: repeated or missing ids stay apart as long as their texts differ."""
    return docs.select("doc_id", "text", F.xxhash64(F.col("text").isNull(), F.col("text")).alias("text_key"))


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` as text and ``text``: pandas would turn whole numbers with gaps into floating point."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")


def long_id(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def sampled_by(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """About ``most`` rows of each value of ``group``, chosen by the hash of ``key``; all rows of smaller groups."""
    shares = [
        (r[0], min(1.0, most / r[1])) for r in rows.groupBy(group).count().collect()]  # a row per label value
    cut = F.lit(False)
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    for value, share in shares:
        cut = cut | (F.col(group).eqNullSafe(F.lit(value)) & (place < F.lit(share)))
    return rows.filter(cut)


def crc_rest(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a missing id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts))
