"""Freely typed values mapped to the entries of a reference list: token repair, then soft TF-IDF over whole entries."""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from directed_extract.operators.skew import join_groups, join_spread
from directed_extract.session import cut

#: Share of an entry's weight that the value must cover, each token counted with its similarity.
COVER = 0.85
#: What one edit takes from the similarity of a token.
EDIT_COST = 0.05
#: A word in at least this share of the reference names is a common word: it may be abbreviated, and short ones mistyped.
#: There can be no more common words than a name has words on average, divided by this.
COMMON_SHARE = 0.01
#: And in at least so many: a few names tell nothing about what is common.
COMMON_LEAST = 10
#: Numbers of so many digits are years or the like and belong to a remark, unless the entry has them itself.
REMARK_DIGITS = 4

# Roman numerals in use for types and grades.
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}
# Words that announce a number.
NUMBER_WORDS = ("type", "tipo", "typ", "t", "grade", "grado", "stage")
# Abbreviations that are no prefix of their word.
SHORT_FORMS = {"sd": "sindrome", "sx": "sindrome", "sdr": "sindrome"}


def tokens(text: str) -> list[str]:
    """The words and numbers of a value, in order.

    Letter case, accents and full-width or invisible characters do not count, nor does what separates words. Dotted
    initials are one word. Letters and digits part company (``abc12`` is ``abc`` and ``12``), except that a 0 or 1 inside a
    word is the letter it was mistaken for. Numbers lose leading zeros; Roman numerals count as numbers, a single letter
    only after a word that announces a number.
    """
    t = unicodedata.normalize("NFKD", text).casefold()
    t = "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    t = re.sub(r"(?<![^\W_])(?:[a-z]\.){2,}[a-z]?(?![^\W_])", lambda m: m[0].replace(".", ""), t)
    parts: list[str] = []
    for run in re.findall(r"[^\W_]+", t):
        inside = re.fullmatch(r"(?=.*[a-z]{2})[a-z01]*[a-z]", run) or re.fullmatch(r"[a-z01]{6,}[a-z][01]", run)
        if inside and re.search("[01]", run):
            parts.append(run.replace("0", "o").replace("1", "l"))
        else:
            parts += re.findall(r"\d+|[^\W\d_]+", run)
    out: list[str] = []
    for p in parts:
        if p in ROMAN and (out and out[-1] in NUMBER_WORDS or out and len(p) > 1):
            p = ROMAN[p]
        elif p.isdecimal():
            p = p.lstrip("0") or "0"
        out.append(p)
    return out


def edits_allowed(token: str) -> int:
    """Numbers and very short words none, words of up to 7 letters one edit, longer ones two."""
    return 0 if token.isdecimal() or len(token) < 4 else 1 if len(token) < 8 else 2


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours as one edit; ``most + 1`` if it is more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] | None = None
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def shortened(token: Column, edits: Column) -> Column:
    """The token with up to ``edits`` (0 to 2) letters left out. Two tokens within that distance share one of these."""
    without = lambda t, i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.char_length(t)))
    places = lambda t: F.sequence(F.lit(1), F.char_length(t))
    one = F.when((edits > 0) & (F.char_length(token) > 0), F.transform(places(token), lambda i: without(token, i)))
    # of the second letter left out it is enough to try those from the first on
    later = lambda i: F.when(i < F.char_length(token), F.transform(F.sequence(i, F.char_length(token) - 1), lambda j: without(without(token, i), j)))
    two = F.when(edits > 1, F.flatten(F.transform(places(token), lambda i: F.coalesce(later(i), F.array().cast("array<string>")))))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(token), F.coalesce(one, none), F.coalesce(two, none)))


def allowed(token: Column) -> Column:
    """:func:`edits_allowed` of a column of words."""
    return F.when(F.length(token) < 4, 0).when(F.length(token) < 8, 1).otherwise(2)


@F.pandas_udf(ArrayType(StringType()))
def _tokens(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else tokens(v))


@F.pandas_udf(IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([distance(x, y, 2) for x, y in zip(a, b, strict=True)])


def numbers(tokens_col: Column) -> Column:
    return F.array_sort(F.filter(tokens_col, lambda t: t.rlike(r"^\d+$")))


def reference_names(reference: DataFrame, entry: str, name: str, aliases: str | None) -> DataFrame:
    """``(concept, toks, nums)``: every name and alias of every entry by its distinct tokens; names without any are left out."""
    said = F.array(F.col(f"`{name}`")) if aliases is None else F.array_union(F.array(F.col(f"`{name}`")), F.coalesce(F.col(f"`{aliases}`"), F.array().cast("array<string>")))
    flat = reference.select(F.col(f"`{entry}`").cast("string").alias("concept"), F.explode(said).alias("name")).filter("name is not null")
    return flat.select("concept", _tokens("name").alias("t")).select("concept", F.array_distinct("t").alias("toks"), numbers(F.col("t")).alias("nums")).filter("size(toks) > 0").distinct()


def near_words(tokens_seen: DataFrame, words: DataFrame) -> DataFrame:
    """``(token, word, d)``: all pairs within the edits that the longer of the two allows, by distance.

    Pairs come from common forms with letters left out, which loses none within two edits. The plain edit distance, in
    which a swap of neighbours costs two, settles most; whether others are swaps shows first in their sorted letters, and
    only what is left is compared letter by letter.
    """
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    # two letters more make the longer word that sets the limit; a token of more than two above the longest is near none
    edits = lambda c: allowed(F.concat(c, F.lit("..")))
    a = tokens_seen.filter((F.length("token") <= longest + 2) & (F.length("token") > 3)).select("token", F.explode(shortened(F.col("token"), edits(F.col("token")))).alias("form"))
    b = words.select("word", F.explode(shortened(F.col("word"), edits(F.col("word")))).alias("form"))
    longer = F.when(F.length("token") > F.length("word"), F.col("token")).otherwise(F.col("word"))
    pairs = a.join(b, "form").select("token", "word").distinct().withColumn("most", allowed(longer)).filter("most > 0")
    pairs = cut(pairs.withColumn("plain", F.levenshtein("token", "word", 4)).filter((F.col("plain") >= 0) & (F.col("plain") <= 2 * F.col("most"))))
    easy = pairs.filter("plain <= 1").select("token", "word", F.col("plain").alias("d"))
    moved = F.levenshtein(letters(F.col("token")), letters(F.col("word")), 2)
    hard = pairs.filter("plain > 1").filter((F.col("plain") <= F.col("most")) | ((moved >= 0) & (moved <= 2 * (2 * F.col("most") - F.col("plain")))))
    return easy.unionByName(hard.withColumn("d", _distance("token", "word")).filter("d <= most").select("token", "word", "d"))


def repair_tokens(seen: DataFrame, vocabulary: DataFrame, common: int) -> DataFrame:
    """``(token, word, sim)``: the words of the reference list each distinct token may stand for.

    ``seen`` has ``token``, ``vocabulary`` ``(word, df)``. A token of the vocabulary stands for itself only. Any other is
    joined to the words within its edits (see :func:`near_words`). A word of at most five letters is only reached this way
    if it is common, in at least ``common`` names: rare short words are symbols, of which another letter makes another
    symbol. Tokens also stand for the common words they begin.
    """
    same = seen.join(vocabulary, seen.token == vocabulary.word, "left_semi").select("token", F.col("token").alias("word"), F.lit(1.0).alias("sim"))
    parts = int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work for each token
    foreign = cut(seen.join(vocabulary, seen.token == vocabulary.word, "left_anti").filter(~F.col("token").rlike(r"^\d+$")).repartition(parts, "token"))
    words = vocabulary.filter(~F.col("word").rlike(r"^\d+$"))
    near = near_words(foreign, words.filter((F.length("word") > 5) | (F.col("df") >= common)))
    near = near.select("token", "word", (1 - F.lit(EDIT_COST) * F.col("d")).alias("sim"))
    often = words.filter(F.col("df") >= common)
    begins = often.filter("length(word) > 1").select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k")).select("word", F.expr("left(word, k)").alias("token"))
    special = often.join(F.broadcast(seen.sparkSession.createDataFrame(list(SHORT_FORMS.items()), "token string, word string")), "word").select("word", "token")
    short = foreign.join(begins.unionByName(special), "token").select("token", "word", F.lit(1 - EDIT_COST).alias("sim"))
    return same.unionByName(near).unionByName(short).groupBy("token", "word").agg(F.max("sim").alias("sim"))


def map_values(values: DataFrame, value: str, reference: DataFrame, entry: str, name: str, aliases: str | None = None, cover: float = COVER) -> DataFrame:
    """``(value, concept, score)`` for every distinct value that denotes an entry of the reference list.

    The score is a soft TF-IDF coverage: the weights (inverse document frequency in the reference list) of an entry's
    tokens, each times the similarity of the best token of the value, over all its weights. Words of the value that the
    entry lacks are remarks and cost nothing; numbers are no remark: those of the value must be exactly those of the
    entry. The best score wins, then the greater weight, then the smaller entry. NULL and values without letters or digits
    denote nothing; ``values`` may repeat, other columns play no part.

    Candidates come from each entry's heaviest tokens, as many as are needed for an entry without any of them to stay
    below ``cover``; so none is lost, and common words like *syndrome* pair nothing.
    """
    names = cut(reference_names(reference, entry, name, aliases).withColumn("id", F.monotonically_increasing_id()))
    n = names.count()
    vocabulary = cut(names.select("id", F.explode("toks").alias("word")).groupBy("word").agg(F.count("*").alias("df")))
    weighed = names.select("id", F.explode("toks").alias("word")).join(vocabulary, "word").withColumn("w", F.log1p(F.lit(float(n)) / F.col("df")))
    entries = weighed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("w", "word")), asc=False).alias("ws"), F.sum("w").alias("total"))
    running = F.transform("ws", lambda x, i: F.aggregate(F.slice("ws", 1, i), F.lit(0.0), lambda s, y: s + y["w"]))
    needed = F.filter(F.arrays_zip(F.col("ws"), running.alias("sum")), lambda z: F.col("total") - z["sum"] >= F.lit(cover) * F.col("total"))
    entries = cut(entries.join(names.select("id", "concept", "nums"), "id").withColumn("keys", F.transform(needed, lambda z: z["ws"]["word"])))

    distinct = cut(values.select(F.col(f"`{value}`").alias("value")).filter("value is not null").distinct().withColumn("t", _tokens("value")))
    each = distinct.select("value", F.explode(F.array_distinct("t")).alias("token"))
    fixes = cut(repair_tokens(each.select("token").distinct(), vocabulary, max(COMMON_LEAST, math.ceil(COMMON_SHARE * n))))
    repaired = cut(each.join(fixes, "token").groupBy("value", "word").agg(F.max("sim").alias("sim")))
    keys = entries.select(F.explode("keys").alias("word"), "id")
    candidates = join_spread(repaired, "value", keys, "word").select("value", "id").distinct()
    found = candidates.join(repaired.groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("word", "sim"))).alias("sims")), "value")
    found = found.join(distinct.select("value", numbers(F.col("t")).alias("said")), "value").join(entries, "id")
    got = F.aggregate("ws", F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.try_element_at("sims", x["word"]), F.lit(0.0)))
    counted = F.filter("said", lambda x: (F.length(x) < REMARK_DIGITS) | F.array_contains("nums", x))
    found = found.filter(counted == F.col("nums")).withColumn("got", got).withColumn("score", F.col("got") / F.col("total")).filter(F.col("score") >= cover)
    best = found.groupBy("value").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), (-F.round("got", 9)).alias("g"), "concept")).alias("b"))
    return best.select("value", F.col("b.concept").alias("concept"), (-F.col("b.s")).alias("score"))


def map_elements(elements: DataFrame, value: str, reference: DataFrame, entry: str, name: str, aliases: str | None = None) -> DataFrame:
    """The rows of ``elements`` whose ``value`` denotes an entry, with ``concept`` and ``score``.

    Only distinct values are mapped. A value that is a third of all rows is joined back by broadcast. Columns of
    ``elements`` that are called like the new ones give way to them.
    """
    rows = cut(elements.drop("concept", "score"))
    counts = rows.filter(F.col(f"`{value}`").isNotNull()).groupBy(F.col(f"`{value}`").alias("value")).agg(F.count("*").alias("_rows"))
    mapped = map_values(rows, value, reference, entry, name, aliases).join(counts, "value").withColumnRenamed("value", value)
    return join_groups(rows, cut(mapped), value, "_rows").drop("_rows")
