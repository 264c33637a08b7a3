"""Duplicates hidden by formatting: canonical keys of records and an incremental ledger of their counts."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from directed_extract.functions.jsonx import let
from directed_extract.operators.skew import join_groups
from directed_extract.session import cut

#: Parts of the ledger's key space at first. A batch reads and rewrites only the parts it has keys in.
BUCKETS = 64
#: Keys of a part, on average, above which the parts are doubled.
BUCKET_KEYS = 4_000_000
#: Whatever is neither letter (with its accents) nor digit.
_DRESS = r"[^\p{L}\p{M}\p{N}]+"
#: What may be a list or object in a value, or a number that is not plainly its digits. Text may look like it, too.
_SPECIAL = r"[:,\[]\s*(?:[\[{]|-?[0-9]+[.eE])"


#: Begins what stands for a nested record; no JSON begins with it.
_DEEP = "\x04deep:"


def _bare(text: str) -> str:
    composed = unicodedata.normalize("NFC", text).lower()
    return "".join(c for c in composed if unicodedata.category(c)[0] in "LMN")


class _Pairs(list):
    """The fields of an object, in order, those named twice included."""


def _parsed(text: str) -> object:
    """JSON with numbers as the text they are written in."""
    return json.loads(text, object_pairs_hook=_Pairs, parse_float=str, parse_int=str, parse_constant=str)


def _nested(value: object) -> object:
    if isinstance(value, _Pairs):
        return ["object", *sorted([_bare(k), json.dumps(_nested(v), ensure_ascii=False)] for k, v in value)]
    if isinstance(value, list):
        return ["list", *[_nested(v) for v in value]]
    return None if value is None else _bare(str(value))


@F.pandas_udf(StringType())
def _composed(values: pd.Series) -> pd.Series:
    """Accents written as separate characters, also as ``\\u`` escapes, joined to their letters."""
    mark = re.compile(r"\\u(03[0-6][0-9a-fA-F])")
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", mark.sub(lambda m: chr(int(m[1], 16)), v)))


@F.pandas_udf(StringType())
def _special(values: pd.Series) -> pd.Series:
    """A record with nested values in its final form, after :data:`_DEEP`; any other as a flat record whose numbers are text."""

    def form(v: str | None) -> str | None:
        if v is None:
            return None
        try:
            record = _parsed(v)
            if not isinstance(record, _Pairs):
                return None
            if any(isinstance(x, list) for _, x in record):
                return _DEEP + json.dumps(_nested(record), ensure_ascii=False)
            said = lambda x: json.dumps(x if x is None else str(x), ensure_ascii=False)
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{said(x)}" for k, x in record) + "}"
        except (ValueError, RecursionError):
            return None

    return values.map(form)


def canonical_record(raw: Column) -> Column:
    """The content of a JSON record free of its dress: fields sorted by name, names and values without letter case, white
    space and punctuation; a number is the text of its digits, nested or not; accents stay (composed or not, they are the
    same).

    Whether a record is nested is decided by its parsed values. Without nested values it is worked out in SQL expressions.
    Python only sees the few rows that may need it: those with nested objects or lists (whose inner field order is no
    difference either), with numbers that have a fraction or an exponent, and with accents written as separate characters.
    A null value is a value of its own, a field named twice has both values. What is no JSON object is only equal to
    itself, byte for byte; NULL gives NULL.
    """
    text = F.regexp_replace(raw, r"^[\s\x{FEFF}]+|\s+$", "")
    text = F.coalesce(_composed(F.when(text.rlike(r"\p{M}|\\u03[0-6]"), text)), text)
    return let(F.coalesce(_special(F.when(text.rlike(_SPECIAL), text)), text), lambda t: _written(t, raw))


def _written(text: Column, raw: Column) -> Column:
    entries = F.map_entries(F.from_json(text, "map<string,string>", {"allowSingleQuotes": "false"}))
    bare = lambda c: F.regexp_replace(F.lower(c), _DRESS, "")
    pair = lambda e: F.concat(bare(e["key"]), F.lit("\x01"), F.coalesce(bare(e["value"]), F.lit("\x02")))
    flat = F.array_join(F.array_sort(F.transform(entries, pair)), "\x03")
    whole = text.startswith("{") & text.endswith("}")
    return F.when(text.startswith(_DEEP), text).otherwise(F.coalesce(F.concat(F.lit("flat:"), F.when(whole, flat)), F.concat(F.lit("raw:"), raw)))


def canonical_key(raw: Column) -> Column:
    """A 32-byte digest of :func:`canonical_record`."""
    return F.unhex(F.sha2(canonical_record(raw), 256))


def batch_counts(keyed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, key, n, first_id)`` of a batch of ``(key, id)``; combined before the shuffle, so hot keys are no burden."""
    got = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return got.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"), "key", "n", "first_id")


def absorb(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """The ledger after a batch: a full outer join by bucket and key, counts added, the earliest representative kept."""
    j = ledger.alias("o").join(batch.alias("b"), (F.col("o.bucket") == F.col("b.bucket")) & (F.col("o.key") == F.col("b.key")), "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(
        F.coalesce("o.bucket", "b.bucket").alias("bucket"), F.coalesce("o.key", "b.key").alias("key"),
        (zero("o.n") + zero("b.n")).cast("bigint").alias("n"), F.least("o.first_id", "b.first_id").alias("first_id"),
    )


class Ledger:
    """A ledger kept as files: one folder per generation, partitioned by bucket, and a manifest of the current ones.

    A batch reads the buckets it has keys in, writes these as a new generation and then a new manifest. A run that dies
    before the manifest is complete leaves the ledger as it was; the same batch can be given again.

    The number of buckets is doubled, and all are rewritten, when they hold more than ``bucket_keys`` keys on average. A
    bucket is no task: large ones are written by several, small ones together, as their sizes ask for.
    """

    SCHEMA = "key binary, n bigint, first_id bigint, bucket int"

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, bucket_keys: int = BUCKET_KEYS) -> None:
        self.spark, self.path, self.least, self.bucket_keys = spark, path.rstrip("/"), buckets, bucket_keys

    def _manifest(self) -> tuple[int, int, dict[int, tuple[int, int]]]:
        """The newest complete manifest: its number, the number of buckets, and generation and keys of each bucket."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        for number in sorted((int(n.partition("=")[2]) for n in names if n.startswith("manifest=")), reverse=True):
            if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest={number}/_SUCCESS")):
                rows = self.spark.read.schema("bucket int, generation int, n bigint, buckets int").parquet(f"{self.path}/manifest={number}").collect()  # one row a bucket
                return number, max((r.buckets for r in rows), default=self.least), {r.bucket: (r.generation, r.n) for r in rows}
        return 0, self.least, {}

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The current counts, of all buckets or of those named."""
        _, buckets, current = self._manifest()
        paths = [f"{self.path}/generation={g}/bucket={b}" for b, (g, _) in sorted(current.items()) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA).select("bucket", "key", "n", "first_id")
        got = self.spark.read.schema("key binary, n bigint, first_id bigint").parquet(*paths)
        return got.select(self._bucket(buckets), "key", "n", "first_id")

    def add(self, keyed: DataFrame) -> None:
        """Count a batch of ``(key, id)`` in."""
        number, buckets, current = self._manifest()
        known = sum(n for _, n in current.values())
        wanted = buckets
        while known > wanted * self.bucket_keys:
            wanted *= 2
        batch = cut(batch_counts(keyed, wanted))
        touched = {r.bucket for r in batch.select("bucket").distinct().collect()}  # at most one row a bucket
        if not touched:
            return
        if wanted == buckets:
            old = self.read(sorted(touched))
        else:
            old = self.read().select(self._bucket(wanted), "key", "n", "first_id")
            current = {}
        here = f"{self.path}/generation={number + 1}"
        absorb(old, batch).hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(here)
        sizes = self.spark.read.parquet(here).groupBy("bucket").agg(F.count("*").alias("n")).collect()
        current |= {r.bucket: (number + 1, r.n) for r in sizes}
        rows = [(b, g, n, wanted) for b, (g, n) in sorted(current.items())]
        self.spark.createDataFrame(rows, "bucket int, generation int, n bigint, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest={number + 1}")


def later_copies(keyed: DataFrame, ledger: DataFrame) -> DataFrame:
    """``(keep_id, copy_id)`` of every row of ``keyed`` (``key, id``) that is not the first of its kind.

    A kind with a third of all rows is joined by broadcast of its one ledger row (see :func:`skew.join_groups`).
    """
    kinds = ledger.filter("n > 1").select("key", "n", "first_id")
    return join_groups(keyed, kinds, "key", "n").filter("id > first_id").select(F.col("first_id").alias("keep_id"), F.col("id").alias("copy_id"))
