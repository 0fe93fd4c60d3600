"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics are Spark expressions of the whole text. Boosted shallow trees are
grown on labelled rows; every path from a root to a node is a rule, a conjunction
of comparisons of statistics. A logistic model with a lasso penalty weighs the
rules and leaves few of them. Those are compiled into one Spark column expression
that scores documents where they are read, with no join and no Python.

Training uses at most `most_rows` labelled rows, those with the smallest hashes of
their ids; all other steps cover all rows. Labels serve as labels alone: neither
they nor lang, source or doc_id are inputs of a score.

Rows: null text counts as empty; empty texts have all statistics 0 and get a
score; labels of unknown or null doc_ids, or null labels, are ignored, and of
repeated labels the largest counts; without labels of both kinds all documents
score the share of label 1 (0.5 without labels); a null doc_id is scored and not
learned from; repeated rows are scored each; other columns are left out."""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import UPPER, materialize

MOST_ROWS, TREES, DEPTH, LASSO = 20_000, 24, 3, 0.0005


#: ASCII characters of a class, counted together; the first stands for all.
CLASSES = {"upper": UPPER, "digits": "0123456789", "spaces": " \t", "stops": ".,", "marks": "!?;:'\"()", "symbols": "#$%&*+/<=>@[\\]^_`{}~-"}
SINGLE = {"lines": "\n", "bars": "|"}


def classed(text: Column) -> Column:
    """The text with each character of a class replaced by the first one of it."""
    return F.translate(text, "".join(v[1:] for v in CLASSES.values()), "".join(v[0] * (len(v) - 1) for v in CLASSES.values()))


def counts(text: Column, folded: Column) -> dict[str, Column]:
    """Counts over the whole text, from it and its classed() form."""
    of = lambda char: F.octet_length(folded) - F.octet_length(F.replace(folded, F.lit(char), F.lit("")))
    return {
        "chars": F.char_length(text),
        "bytes": F.octet_length(text),
        **{k: of(v[0]) for k, v in (CLASSES | SINGLE).items()},
        "kinds": F.size(F.array_distinct(F.split(F.replace(F.lower(text), F.lit("\n"), F.lit(" ")), " "))),
        "line_kinds": F.size(F.array_distinct(F.split(text, "\n"))),
    }


def ratios(c=F.col) -> dict[str, Column]:
    """Statistics from the counts, which c finds by name; each is 0 for an empty text."""
    per = lambda a, b: F.coalesce(F.try_divide(c(a).cast("double"), b), F.lit(0.0))
    words = c("spaces") + c("lines") + 1
    return {
        "log_chars": F.log1p(c("chars").cast("double")),
        "wide_share": F.coalesce(F.try_divide((c("bytes") - c("chars")).cast("double"), c("chars")), F.lit(0.0)),
        "upper_share": per("upper", c("chars")),
        "digit_share": per("digits", c("chars")),
        "space_share": per("spaces", c("chars")),
        "line_share": per("lines", c("chars")),
        "stop_share": per("stops", c("chars")),
        "mark_share": per("marks", c("chars")),
        "symbol_share": per("symbols", c("chars")),
        "bar_share": per("bars", c("chars")),
        "word_length": F.coalesce(F.try_divide((c("chars") - c("spaces") - c("lines")).cast("double"), words), F.lit(0.0)),
        "word_kinds": F.when(c("chars") > 0, per("kinds", words)).otherwise(0.0),
        "line_kinds_share": F.when(c("chars") > 0, per("line_kinds", c("lines") + 1)).otherwise(0.0),
    }


#: Their names, in the order of the classifier's inputs.
STATISTICS = (
    "log_chars", "wide_share", "upper_share", "digit_share", "space_share", "line_share", "stop_share",
    "mark_share", "symbol_share", "bar_share", "word_length", "word_kinds", "line_kinds_share",
)


def _bound(rows: DataFrame, values: dict[str, Column]) -> tuple[DataFrame, str]:
    """rows with the values as a struct under a name of its own. A generator works
    them out once a row; a projection would be merged into what uses them."""
    name = "stats"
    while name in rows.columns:
        name += "_"
    return rows.select("*", F.explode(F.array(F.struct(*(v.alias(k) for k, v in values.items())))).alias(name)), name


def with_statistics(documents: DataFrame) -> tuple[DataFrame, str]:
    """documents and the name of a struct column of STATISTICS; each function of the
    text runs once a document, however often rules use its result."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows, both = _bound(documents, {"text": text, "folded": classed(text)})
    rows, own = _bound(rows, counts(F.col(f"{both}.text"), F.col(f"{both}.folded")))
    return _bound(rows.drop(both), ratios(lambda name: F.col(f"{own}.{name}")))


def statistics(documents: DataFrame, *keep: str) -> DataFrame:
    rows, own = with_statistics(documents)
    return rows.select(*keep, f"{own}.*")


Rule = tuple[tuple[int, bool, float], ...]


def tree_rules(model) -> list[Rule]:
    """Conjunctions (statistic, at most?, threshold) on all paths of all trees."""
    found: dict[Rule, None] = {}

    def walk(node, path: Rule) -> None:
        if path:
            found.setdefault(tuple(sorted(path)))
        if node.numDescendants() > 0:
            split = node.split()
            i, at = int(split.featureIndex()), float(split.threshold())
            walk(node.leftChild(), (*path, (i, True, at)))
            walk(node.rightChild(), (*path, (i, False, at)))

    for tree in model.trees:
        walk(tree._call_java("rootNode"), ())
    return list(found)


def holds(rule: Rule, c=F.col) -> Column:
    parts = [c(STATISTICS[i]) <= at if most else c(STATISTICS[i]) > at for i, most, at in rule]
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


class RuleModel:
    """score: a column expression of the statistics."""

    def __init__(self, base: float, rules: list[tuple[Rule, float]]):
        self.base, self.rules = base, rules

    def score(self, c=F.col) -> Column:
        total = F.lit(self.base)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule, c), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS) -> RuleModel:
    """Learns from labelled documents that are not held out."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("double")).alias("label"))
    chosen = materialize(known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows), "labelled")
    rows = statistics(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "doc_id", "label")
    # one row an id, the least, however many rows repeat it
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct(*STATISTICS)).alias("least")).select("doc_id", "label", "least.*")
    rows = materialize(rows, "statistics")
    share = rows.agg(F.avg("label")).first()[0]
    if share is None:
        return RuleModel(0.0, [])
    if not 0 < share < 1:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return RuleModel(math.log(share / (1 - share)), [])
    # at most most_rows rows of a few numbers: one task each for a hundred small jobs
    rows = rows.coalesce(1).sortWithinPartitions("doc_id")
    inputs = VectorAssembler(inputCols=list(STATISTICS), outputCol="inputs").transform(rows).cache()
    trees = GBTClassifier(featuresCol="inputs", labelCol="label", maxDepth=DEPTH, maxIter=TREES, maxBins=64, stepSize=0.2, seed=7).fit(inputs)
    rules = tree_rules(trees)
    inputs.unpersist()
    fired = rows.select("label", *(holds(r).cast("double").alias(f"r{k}") for k, r in enumerate(rules)))
    fired = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="rules").transform(fired).select("label", "rules").cache()
    lasso = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=100).fit(fired)
    fired.unpersist()
    weights = lasso.coefficients.toArray()
    return RuleModel(float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, weights) if w])


def classify(documents: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit(documents, labels, label)
    rows, own = with_statistics(documents.select("doc_id", "text"))
    scored = rows.select("doc_id", held_out().alias("held_out"), model.score(lambda name: F.col(f"{own}.{name}")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The rows of documents that score 0.5 or more, with all their columns and no
    others; scores are computed where the texts are read."""
    model = fit(documents, labels, label)
    rows, own = with_statistics(documents)
    return rows.where(model.score(lambda name: F.col(f"{own}.{name}")) >= 0.5).select(*(F.col(f"`{c}`") for c in documents.columns))
