"""Personal information in free text: weak labels, their reliabilities by EM, a span classifier, and placeholders."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from directed_extract.llm import pii_labels
from directed_extract.operators.skew import join_lookup
from directed_extract.session import cut

#: Candidates the classifiers are trained on, at most, shared out among the types. Which ones depends on a hash of text and
#: place, not on order.
TRAIN_ROWS = 40_000
#: Names of the gazetteer sent to every worker, at most; a longer list is joined to the words of the texts.
MAX_NAMES = 500_000
#: A candidate counts if the classifier gives it at least this probability.
ACCEPT = 0.5
EM_ROUNDS = 60
EPOCHS = 30
#: Hashes are taken modulo this, so that a share of any size can be told.
_HASHES = 1 << 62


@dataclass(frozen=True)
class Reliability:
    """What EM found for one type: how likely each vote of each labeler is for true and for false candidates."""

    prior: float
    true: np.ndarray
    false: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of truth for rows of votes (-1, 0, 1)."""
        at = votes.astype(int) + 1
        k = np.arange(votes.shape[1])
        good = np.log(self.prior) + np.log(self.true[k, at]).sum(axis=1)
        bad = np.log1p(-self.prior) + np.log(self.false[k, at]).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> Reliability:
    """Expectation-maximisation over distinct vote patterns and how often each occurs.

    Labelers are taken to err independently given the truth. It starts from the sum of votes, and labelers keep a small
    prior in favour of being right, so that the two classes cannot change places.
    """
    n, k = votes.shape
    post = 1 / (1 + np.exp(-2.0 * votes.sum(axis=1)))
    lean = np.array([0.5, 1.0, 2.0])
    prior, true, false = 0.5, np.full((k, 3), 1 / 3), np.full((k, 3), 1 / 3)
    for _ in range(rounds):
        w1, w0 = counts * post, counts * (1 - post)
        prior = float(np.clip((w1.sum() + 1) / (counts.sum() + 2), 1e-6, 1 - 1e-6))
        for j in range(k):
            for v in range(3):
                at = votes[:, j] == v - 1
                true[j, v] = w1[at].sum() + lean[v]
                false[j, v] = w0[at].sum() + lean[2 - v]
        true /= true.sum(axis=1, keepdims=True)
        false /= false.sum(axis=1, keepdims=True)
        post = Reliability(prior, true, false).posterior(votes)
    return Reliability(prior, true.copy(), false.copy())


def train(features: list[np.ndarray], target: np.ndarray, size: int = pii_labels.FEATURES, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of a logistic regression on binary features with soft targets (AdaGrad, a little L2, fixed order)."""
    w, g = np.zeros(size), np.full(size, 1e-6)
    order = np.random.default_rng(7).permutation(len(features))
    for _ in range(epochs):
        for block in np.array_split(order, max(1, len(order) // 64)):
            sizes = [len(features[i]) for i in block]
            flat, rows = np.concatenate([features[i] for i in block]), np.repeat(np.arange(len(block)), sizes)
            z = np.bincount(rows, weights=w[flat], minlength=len(block))
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[block]
            grad = np.bincount(flat, weights=error[rows], minlength=size) / len(block) + 1e-5 * w
            g += grad * grad
            w -= 0.3 * grad / np.sqrt(g)
    return w


def gazetteer(lexicon: DataFrame, name: str, kind: str, most: int = MAX_NAMES) -> dict[str, str] | DataFrame:
    """Lower-case name to its kinds. With more than ``most`` rows the names stay a table ``(n, k)``, which the words of the
    texts are joined to, and do not go to every worker."""
    names = lexicon.select(F.lower(F.trim(F.col(name))).alias("n"), F.col(kind).alias("k")).filter("n <> ''").distinct()
    rows = names.limit(most + 1).collect()
    if len(rows) > most:
        return names.groupBy("n").agg(F.array_join(F.array_sort(F.collect_set("k")), " ").alias("k"))
    out: dict[str, str] = {}
    for r in rows:
        out[r.n] = " ".join(sorted({*out.get(r.n, "").split(), r.k or ""})).strip()
    return out


def _with_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``(id, text, names)``: the texts with the listed names among their own words, as a map to their kinds.

    Distinct words travel, once for each text; a word of a third of the texts is one of few and is joined by broadcast.
    """
    rows = cut(texts)
    words = cut(rows.select("id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{Nl}\p{No}]+"), F.lit(0)), F.lower))).alias("n")))
    found = join_lookup(words, names, "n").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("n", "k"))).alias("names"))
    return rows.join(found, "id", "left")


def candidate_spans(df: DataFrame, key: str, text: str, known: dict[str, str] | DataFrame) -> DataFrame:
    """``(id, kind, s, e, votes, features)`` of every candidate span in every whole text; ends are exclusive."""
    kind = df.schema[key].dataType.simpleString()
    texts = df.filter(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(known if isinstance(known, dict) else {})
    texts = texts.withColumn("names", F.lit(None).cast("map<string,string>")) if isinstance(known, dict) else _with_names(texts, known)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listed = shared.value
        for b in batches:
            rows = [(i, c.kind, c.start, c.end, c.votes, c.features) for i, t, own in zip(b["id"], b["text"], b["names"], strict=True) for c in pii_labels.candidates(t, dict(own) if own else listed)]
            yield pd.DataFrame(rows, columns=["id", "kind", "s", "e", "votes", "features"])

    return texts.mapInPandas(scan, f"id {kind}, kind string, s int, e int, votes array<int>, features array<int>")


def quotas(counts: dict[str, int], rows: int) -> dict[str, int]:
    """``rows`` shared out evenly: a type with fewer takes all it has, and the others share what it leaves."""
    out: dict[str, int] = {}
    for i, kind in enumerate(sorted(counts, key=lambda k: (counts[k], k))):
        out[kind] = min(counts[kind], (rows - sum(out.values())) // (len(counts) - i))
    return out


def fit(candidates: DataFrame, train_rows: int = TRAIN_ROWS) -> dict[str, np.ndarray | Reliability]:
    """A classifier for each type of span, or what EM found for a type without a sampled candidate.

    Reliabilities are estimated from the votes of all candidates; only the distinct vote patterns with their counts reach
    the driver (at most 3 to the number of labelers). Candidates labelled by them train the classifiers, at most about
    ``train_rows`` in all, taken by hash within each type: a rare type gives all it has.
    """
    patterns = candidates.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    counts = {k: sum(r.n for r in patterns if r.kind == k) for k in sorted({r.kind for r in patterns})}
    below = F.lit(0)
    for kind, rows in quotas(counts, train_rows).items():
        below = F.when(F.col("kind") == kind, F.lit(rows * _HASHES // counts[kind])).otherwise(below)
    picked = candidates.filter(F.pmod(F.xxhash64("id", "s", "kind"), F.lit(_HASHES)) < below)
    sample = picked.select("kind", "votes", "features").limit(2 * train_rows).toPandas()
    out: dict[str, np.ndarray | Reliability] = {}
    for kind in counts:
        mine = [r for r in patterns if r.kind == kind]
        found = estimate(np.array([r.votes for r in mine]), np.array([float(r.n) for r in mine]))
        rows = sample[sample["kind"] == kind]
        out[kind] = found
        if len(rows):
            target = found.posterior(np.array(rows["votes"].tolist()))
            out[kind] = train([np.asarray(f, dtype=int) for f in rows["features"]], target)
    return out


def find_spans(df: DataFrame, key: str, text: str, known: dict[str, str] | DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``(<key>, pii_type, s, e, p)``: the spans of personal information in every text; 0-based, the end exclusive.

    Where accepted candidates overlap, the more probable one stays, then the longer, then the earlier. Texts that are NULL
    or empty have none. ``key`` must be unique; other columns of ``df`` play no part.
    """
    found = cut(candidate_spans(df, key, text, known))
    models = fit(found)

    @F.pandas_udf(DoubleType())
    def probability(kind: pd.Series, votes: pd.Series, features: pd.Series) -> pd.Series:
        out = np.zeros(len(kind))
        for k, places in kind.groupby(kind).indices.items():
            model = models[k]
            if isinstance(model, Reliability):
                out[places] = model.posterior(np.stack(votes.iloc[places].to_list()))
            else:  # every candidate has features
                own = features.iloc[places].to_list()
                first = np.cumsum([0, *map(len, own[:-1])])
                out[places] = 1 / (1 + np.exp(-np.clip(np.add.reduceat(model[np.concatenate(own)], first), -30, 30)))
        return pd.Series(out)

    scored = found.withColumn("p", probability("kind", "votes", "features")).filter(F.col("p") >= accept).select("id", "kind", "s", "e", "p")

    @F.pandas_udf("array<struct<kind:string,s:int,e:int,p:double>>")
    def settled(spans: pd.Series) -> pd.Series:
        return spans.map(lambda group: [{"kind": k, "s": s, "e": e, "p": p} for k, s, e, p in _settle(group)])

    grouped = scored.groupBy("id").agg(F.collect_list(F.struct("kind", "s", "e", "p")).alias("spans"))
    flat = grouped.select("id", F.explode(settled("spans")).alias("x"))
    return flat.select(F.col("id").alias(key), F.col("x.kind").alias("pii_type"), "x.s", "x.e", "x.p")


def _settle(spans: list[dict]) -> list[tuple]:
    kept: list[tuple] = []
    for r in sorted(spans, key=lambda r: (-round(r["p"], 6), r["s"] - r["e"], r["s"], r["kind"])):
        if all(r["e"] <= s or e <= r["s"] for _, s, e, _ in kept):
            kept.append((r["kind"], int(r["s"]), int(r["e"]), float(r["p"])))
    return sorted(kept, key=lambda k: k[1])


def redact(df: DataFrame, key: str, text: str, spans: DataFrame) -> DataFrame:
    """``(<key>, text, n_redacted)``: each span replaced by its type in square brackets, every other character unchanged.

    Texts without a span come out as they are, NULL stays NULL. Texts are read once.
    """
    by_row = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("s", "e", "pii_type"))).alias("spans"))
    rows = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text")).join(by_row, key, "left")
    # what stands between the end of each span and the beginning of the next; the spans' types come in between
    edge = F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit(None).cast("string").alias("pii_type"))
    from_here = F.concat(F.array(edge), F.col("spans"))

    def piece(x: Column, i: Column) -> Column:
        ends = F.coalesce(F.try_element_at("spans", i + 1)["s"], F.char_length("text"))
        label = F.when(x["pii_type"].isNull(), "").otherwise(F.concat(F.lit("["), F.upper(x["pii_type"]), F.lit("]")))
        return F.concat(label, F.substring(F.col("text"), x["e"] + 1, ends - x["e"]))

    changed = F.array_join(F.transform(from_here, piece), "")
    return rows.select(key, F.when(F.col("spans").isNull(), F.col("text")).otherwise(changed).alias("text"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_redacted"))
