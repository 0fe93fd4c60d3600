"""Personal data: candidate spans, boosted trees and calibrated thresholds.

Generators are regular expressions over whole texts: the four of the base rules,
whose matches are dropped where they fail their check and stay otherwise, and
high-recall ones that also propose addresses in disguise and any long digits with
separators, overlapping those.

Boosted trees score every proposal by its format and its surroundings. What they
learn does not come from a rule on the span itself, but from what was done to it:
spans that the base rules confirm are written anew where they stand, in disguises whose
signs are drawn at random (separators, spelled signs, brackets, forms of a number at
home), which the base rules no longer see, as true ones; and broken (a wrong check digit,
a part beyond 255, too few or too many digits, a date, a price, a list or prose of the
same shape) as false ones. Where few are confirmed, each takes several turns with other
digits, so that small tables teach as much as large ones. Proposals that no reading
of theirs could be data (digits that fail the check or the count, or inside a word)
are false ones too. Other proposals are scored and not learned from. At most
`most_rows` rows are learned from, those of least hash.

A part of the rows, not learned from, calibrates a threshold for each kind: the least
score at and above which at least `precision` of them are true. Proposals that reach
it and overlap no confirmed span are added, by score, unless they overlap an added one.

Everything is built-in expressions and windows over proposals; texts are read once
for them. Proposals of a document are never gathered but in its own result.

Rows: null text is empty; rows equal in doc_id and text have equal results, each its
own row; a null doc_id is a document; other columns are ignored; documents without
proposals, and tables without rows, make no model and add no span."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
# A match begins where its run of characters does, or where the last match ended:
# the same matches as without that, in linear time. Groups repeat possessively (++),
# which changes no match here and spares the regex engine its recursion.
_LOCAL = "[A-Za-z0-9._%+-]"
_DIGITS = r"(?:(?<![0-9])|\G)[0-9]"
#: name: (kind, pattern); the first four are the base rules.
# Signs in disguise: a word or the sign itself in any bracket, or with spaces around.
_AT = r"(?:\x20?[(\[{<]\x20?(?:@|[Aa][Tt])\x20?[)\]}>]\x20?|\x20?@\x20?)"
_DOT = r"(?:\x20?[(\[{<]\x20?(?:\.|[Dd][Oo][Tt])\x20?[)\]}>]\x20?|\x20?\.\x20?|\x20[Dd][Oo][Tt]\x20)"
_TIGHT_DOT = r"(?:\x20?[(\[{<]\x20?(?:\.|[Dd][Oo][Tt])\x20?[)\]}>]\x20?|\.|\x20[Dd][Oo][Tt]\x20)"
GENERATORS = {
    "email": ("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"),
    "ip": ("ip", rf"{_DIGITS}+\.[0-9]+\.[0-9]+\.[0-9]+"),
    "card": ("card", rf"{_DIGITS}(?:[\x20-]?[0-9])++"),
    "phone": ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "masked": ("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}+(?:{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)++|\x20[Aa][Tt]\x20[A-Za-z0-9-]+(?:{_TIGHT_DOT}[A-Za-z0-9-]+)++)"),
    "called": ("phone", rf"\+?\(?{_DIGITS}(?:[\x20()./_-]{{0,3}}[0-9]){{6,24}}"),
    "typed": ("card", rf"{_DIGITS}(?:[\x20.,:*/_-]{{0,3}}[0-9]){{12,18}}(?![0-9])"),
    "spread": ("ip", rf"{_DIGITS}+(?:(?:\x20?[(\[{{<]?\x20?(?:[.,]|[Dd][Oo][Tt])\x20?[)\]}}>]?\x20?)[0-9]+){{3}}"),
}
BASE = KINDS
AROUND, MOST_ROWS, TREES, DEPTH, PRECISION = 48, 20_000, 24, 5, 0.99
#: Common last labels of domains.
LAST_LABELS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "co", "us", "uk", "de", "fr", "es", "it", "nl", "eu", "ch", "at", "ca", "au", "jp", "example", "test", "invalid")
#: What may hold a spelled sign, or any sign at all.
_SPELLED = r"@|[(\[{<]\x20?[Aa][Tt]\x20?[)\]}>]|\x20[Aa][Tt]\x20[A-Za-z0-9-]+(?:\.[A-Za-z0-9]|\x20[Dd][Oo][Tt]\x20|\x20?[(\[{<])"


def _row(name: str, kind: str):
    return lambda x, i: F.struct(
        F.lit(name).alias("gen"), F.lit(kind).alias("kind"), i.alias("idx"), F.char_length(x["p"]).alias("gap"), x["m"].alias("match"),
        F.right(x["p"], F.lit(AROUND)).alias("before"), F.left(x["q"], F.lit(AROUND)).alias("after"),
    )


def proposals(documents: DataFrame) -> DataFrame:
    """(doc_id, copy, gen, kind, idx, start, end, match, before, after): all matches of
    all generators, in code points, end exclusive."""
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.col("text").rlike(rf"[0-9]|{_SPELLED}"))
    found = []
    for name, (kind, pattern) in GENERATORS.items():
        needs = F.col("text").rlike("[0-9]") if kind != "email" else F.col("text").rlike(_SPELLED)
        pieces = F.split("text", pattern, -1)
        matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        zipped = F.arrays_zip(pieces.alias("p"), matches.alias("m"), F.slice(pieces, 2, 1 << 30).alias("q"))
        rows = F.transform(zipped, _row(name, kind))
        found.append(F.when(needs, F.filter(rows, lambda r: r["match"].isNotNull())))
    nothing = F.array().cast("array<struct<gen:string,kind:string,idx:int,gap:int,match:string,before:string,after:string>>")
    each = texts.select("doc_id", F.xxhash64("text").alias("copy"), F.explode(F.concat(*(F.coalesce(f, nothing) for f in found))).alias("x")).select("doc_id", "copy", "x.*")
    each = each.dropDuplicates(["doc_id", "copy", "gen", "idx"])
    length = F.char_length("match")
    upto = F.sum(F.col("gap") + length).over(Window.partitionBy("doc_id", "copy", "gen").orderBy("idx"))
    return each.withColumn("end", upto.cast("int")).withColumn("start", F.col("end") - length).drop("gap")


def luhn(digits: Column) -> Column:
    n = F.char_length(digits)
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 1, double(F.substring(digits, i, F.lit(1)).cast("int"))).otherwise(F.substring(digits, i, F.lit(1)).cast("int")))
    return F.when(n > 0, F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0).otherwise(False)


FEATURES = ("length", "digits", "groups", "longest", "first", "last", "spaces", "dots", "slashes", "hyphens", "brackets", "plus", "at", "letters", "octets", "checks", "glued_left", "glued_right", "named", "commas", "lines", "others", "second", "least", "threes", "zero", "opened", "signs", "last_label", "words", "is_email", "is_ip", "is_card", "is_phone")


def described(found: DataFrame, *keep: str) -> DataFrame:
    """Adds format and context features; whether a base rule confirms the span (base);
    and whether no reading of it could be data (vain)."""
    m = F.col("match")
    count = lambda pattern: F.regexp_count(m, F.lit(pattern)).cast("double")
    groups = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    digits = F.regexp_replace(m, "[^0-9]", "")
    small = F.forall(groups, lambda g: (F.char_length(F.ltrim(g, F.lit("0"))) <= 3) & (F.right(g, F.lit(3)).cast("int") <= 255))
    found = found.withColumn("n", F.char_length(digits)).withColumn("luhn", luhn(digits)).withColumn("small", small)
    passes = (
        F.when(F.col("gen") == "email", True)
        .when(F.col("gen") == "ip", F.col("small"))
        .when(F.col("gen") == "card", F.col("n").between(13, 19) & F.col("luhn"))
        .when(F.col("gen") == "phone", F.col("n").between(9, 15))
        .otherwise(False)
    )
    inside = F.col("before").rlike("[A-Za-z0-9]$") | F.col("after").rlike("^[A-Za-z0-9]")
    vain = (
        F.when(F.col("kind") == "ip", ~F.col("small"))
        .when(F.col("kind") == "card", ~(F.col("n").between(13, 19) & F.col("luhn")))
        .when(F.col("kind") == "phone", ~F.col("n").between(9, 15) | inside)
        .otherwise(False)
    )
    words = F.concat(F.lower("before"), F.lit(" "), F.lower("after"))
    named = words.rlike("mail|phone|tel|call|fax|card|visa|credit|contact|ip|host|address")
    size_of = lambda g: F.coalesce(F.char_length(g), F.lit(0)).cast("double")
    values = {
        "length": F.char_length(m).cast("double"), "digits": F.col("n").cast("double"), "groups": F.size(groups).cast("double"),
        "longest": F.coalesce(F.array_max(F.transform(groups, F.char_length)), F.lit(0)).cast("double"),
        "first": size_of(F.get(groups, F.lit(0))), "last": size_of(F.get(groups, F.size(groups) - 1)),
        "spaces": count(" "), "dots": count("\\."), "slashes": count("/"), "hyphens": count("-"), "brackets": count("[()\\[\\]]"), "plus": count("\\+"), "at": count("@|at"), "letters": count("[A-Za-z]"),
        "octets": (F.col("small") & (F.size(groups) == 4)).cast("double"), "checks": F.col("luhn").cast("double"),
        "glued_left": F.col("before").rlike("[A-Za-z0-9]$").cast("double"), "glued_right": F.col("after").rlike("^[A-Za-z0-9]").cast("double"), "named": named.cast("double"),
        "commas": count(","), "lines": count("_"), "others": count("[:*{}<>]"), "second": size_of(F.get(groups, F.lit(1))), "least": F.coalesce(F.array_min(F.transform(groups, F.char_length)), F.lit(0)).cast("double"),
        "threes": F.size(F.filter(groups, lambda g: F.char_length(g) == 3)).cast("double"), "zero": m.rlike("^\\(?0").cast("double"), "opened": m.rlike("^\\+?\\(").cast("double"),
        "signs": F.size(F.array_distinct(F.regexp_extract_all(m, F.lit("[^A-Za-z0-9]+"), F.lit(0)))).cast("double"),
        "last_label": F.lower(F.regexp_extract(m, "([A-Za-z]+)$", 1)).isin(*LAST_LABELS).cast("double"), "words": F.regexp_count(m, F.lit("(?i)\\b(at|dot)\\b")).cast("double"),
        **{f"is_{k}": (F.col("kind") == k).cast("double") for k in KINDS},
    }
    return found.select("doc_id", "copy", "gen", "kind", "start", "end", "match", "before", "after", passes.alias("base"), vain.alias("vain"), *keep, *(F.coalesce(v, F.lit(0.0)).alias(k) for k, v in values.items()))


#: Disguises of each kind that nothing is learned from, to measure what the model finds.
HELD_FORMS = ("mixed", "slashes", "stops", "round")
#: Forms of a kind, about, and turns that a confirmed span takes at most.
FORMS, MOST_TURNS = 12, 40


#: Signs that disguises draw from; HELD_FORMS use others.
AT_SIGNS = (" (at) ", "(at)", "[at]", " {at} ", "<at>", " AT ", " at ", " At ", " @ ", "@", " (@) ", "[@]", "(AT)")
DOT_SIGNS = (".", " . ", " (dot) ", "(dot)", " [dot] ", "[dot]", " DOT ", " dot ", "[.]", "{dot}", " Dot ", "(.)")
OCTET_SIGNS = ("[.]", " . ", " dot ", "(dot)", "[dot]", " DOT ", ",", " [.] ", "{.}", " (dot) ", "<.>")
CARD_SIGNS = (".", "/", "_", "-", " - ", "  ", ":", " / ", "*", ",", " . ")
PHONE_SIGNS = ("-", ".", " ", " - ", "_")


def rewritten(confirmed: DataFrame) -> DataFrame:
    """Of (match, kind, turn, ...) rows that base rules confirm: each match as it is, in
    disguises whose signs are drawn anew for each turn, and broken, as (form, match, label).
    Digits and letters of later turns are other ones."""
    m = F.col("match")
    digits, groups = F.regexp_replace(m, "[^0-9]", ""), F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    form = lambda name, text, label=1.0: F.struct(F.lit(name).alias("form"), text.alias("match"), F.lit(label).alias("label"))
    joined = lambda a, sep: F.array_join(a, sep) if isinstance(sep, str) else F.aggregate(F.slice(a, 2, 20), F.get(a, F.lit(0)), lambda x, y: F.concat(x, sep, y))
    seed = lambda salt: F.xxhash64("copy", "start", "turn", F.lit(salt))
    pick = lambda options, salt: F.element_at(F.array(*map(F.lit, options)), (F.pmod(seed(salt), F.lit(len(options))) + 1).cast("int"))
    fours = lambda d, sep: joined(F.regexp_extract_all(d, F.lit("[0-9]{1,4}"), F.lit(0)), sep)
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    some = F.rpad(digits, 12, "4178052396")
    cut = lambda a, n: F.substring(some, a, n)
    wrong = F.concat(F.substring(digits, F.lit(1), F.char_length(digits) - 1), ((F.right(digits, F.lit(1)).cast("int") + 1) % 10).cast("string"))
    beyond = F.concat(F.array((F.get(groups, F.lit(0)).cast("long") + 256).cast("string")), F.slice(groups, 2, 3))
    date = F.concat(F.lit("20"), cut(1, 2), F.lit("-0"), cut(3, 1), F.lit("-1"), cut(4, 1), F.lit(" 1"), cut(5, 1))
    at, dot, octet, bar, gap = pick(AT_SIGNS, "at"), pick(DOT_SIGNS, "dot"), pick(OCTET_SIGNS, "octet"), pick(CARD_SIGNS, "card"), pick(PHONE_SIGNS, "phone")
    word = F.coalesce(F.nullif(F.lower(F.regexp_extract("before", "([A-Za-z]{3,})[^A-Za-z]*$", 1)), F.lit("")), F.lit("then"))
    prose = F.concat(word, at, F.regexp_extract(local, "^([A-Za-z0-9]*)", 1), F.lit("s"), dot, word, F.lit("ly"))
    # a number at home: its last ten digits, or with a zero before nine of them
    ten, nine = F.right(F.lpad(digits, 10, "2125550"), F.lit(10)), F.right(digits, F.lit(9))
    part = lambda d, a, n: F.substring(d, a, n)
    area = F.concat(pick(("(", "("), "open"), part(ten, 1, 3), pick((") ", ")", ")-"), "close"), part(ten, 4, 3), pick(("-", ".", " "), "tail"), part(ten, 7, 4))
    home = F.concat(part(ten, 1, 3), gap, part(ten, 4, 3), gap, part(ten, 7, 4))
    trunk = F.concat(F.lit("0"), part(ten, 1, 2), gap, part(ten, 3, 4), gap, part(ten, 7, 4))
    city = F.concat(pick(("(0", "0"), "city"), part(nine, 1, 3), F.when(pick(("(0", "0"), "city") == "(0", ") ").otherwise(gap), part(nine, 4, 3), gap, part(nine, 7, 3))
    forms = {
        "email": [
            form("as it is", m), *(form("drawn", F.concat(local, a, F.replace(domain, F.lit("."), d))) for a, d in ((at, dot), (pick(AT_SIGNS, "at2"), F.lit(".")), (F.lit("@"), pick(DOT_SIGNS, "dot2")), (pick((" AT ", " at ", " At "), "at3"), pick((" DOT ", " dot ", ".", " Dot "), "dot3")))),
            form("mixed", F.concat(local, F.lit(" [at] "), domain)),
            form("prices", F.concat(cut(1, 2), at, cut(3, 1), dot, cut(4, 2)), 0.0), form("prices", F.concat(cut(1, 1), F.lit(" @ "), cut(2, 2), F.lit("."), cut(4, 2)), 0.0), form("prose", prose, 0.0), form("prose", F.concat(word, F.lit(" at "), word, F.lit("."), word), 0.0),
        ],
        "ip": [
            form("as it is", m), form("drawn", joined(groups, octet)), form("drawn", joined(groups, pick(OCTET_SIGNS, "octet2"))), form("round", joined(groups, "(.)")),
            form("far", joined(beyond, "."), 0.0), form("far", joined(beyond, octet), 0.0), form("list", joined(groups, ", "), 0.0),
        ],
        "card": [
            form("as it is", m), form("drawn", fours(digits, bar)), form("drawn", fours(digits, pick(CARD_SIGNS, "card2"))), form("stops", fours(digits, ". ")),
            form("wrong", wrong, 0.0), form("wrong", fours(wrong, bar), 0.0), form("wrong", fours(wrong, "-"), 0.0),
        ],
        "phone": [
            form("as it is", m), form("bare", F.ltrim(m, F.lit("+"))), form("drawn", joined(groups, gap)), form("area", area), form("home", home), form("trunk", trunk), form("city", city), form("slashes", joined(groups, "/")),
            form("short", joined(F.slice(groups, 1, 2), "-"), 0.0), form("long", F.concat(digits, digits), 0.0), form("plain", F.left(F.concat(digits, digits), F.lit(13)), 0.0), form("plain", digits, 0.0), form("plain", ten, 0.0), form("date", date, 0.0),
            form("thousands", joined(F.array(cut(1, 2), cut(3, 3), cut(6, 3), cut(9, 3)), pick((" ", ".", "."), "thousands")), 0.0), form("fours", fours(cut(1, 12), gap), 0.0), form("range", F.concat(cut(1, 6), gap, cut(7, 6)), 0.0), form("years", F.concat(F.lit("19"), cut(1, 2), gap, F.lit("20"), cut(3, 2), gap, cut(5, 4)), 0.0),
        ],
    }
    out = None
    for kind, each in forms.items():  # a projection for each kind: one for all would be too large to compile
        own = confirmed.where(F.col("kind") == kind).select("doc_id", "copy", "kind", "start", "end", "before", "after", F.explode(F.array(*each)).alias("f"))
        out = own if out is None else out.unionByName(own)
    return out.select("doc_id", "copy", "kind", "start", "end", "before", "after", "f.*")


def _turned(confirmed: DataFrame, turns: Column) -> DataFrame:
    """Each confirmed span so many times, from the second on with other digits."""
    out = confirmed.withColumn("turn", F.explode(F.sequence(F.lit(0), turns - 1)))
    shift = F.when(F.col("turn") > 0, F.pmod(F.xxhash64("copy", "start", "turn", F.lit("shift")), F.lit(9)) + 1).otherwise(0).cast("int")
    out = out.withColumn("_shift", shift)
    turned = F.expr("translate(match, '0123456789', substring('01234567890123456789', _shift + 1, 10))")
    # a card's last digit, and parts of an address, are made right again
    body = F.regexp_replace(turned, "[0-9]([^0-9]*)$", "")
    digits = F.regexp_replace(body, "[^0-9]", "")
    check = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string")), lambda d: luhn(F.concat(digits, d)))
    card = F.concat(body, F.get(check, F.lit(0)))
    ip = F.array_join(F.transform(F.split(turned, "\\."), lambda g: (F.right(g, F.lit(3)).cast("int") % 256).cast("string")), ".")
    # an address of the same letters, without its digits or with them, of other lengths
    draw = lambda n, salt: F.pmod(F.xxhash64("copy", "start", "turn", F.lit(salt)), F.lit(n)).cast("int")
    one_of = lambda options, salt: F.element_at(F.array(*map(F.lit, options)), draw(len(options), salt) + 1)
    letters = F.concat(F.regexp_replace(F.substring_index("match", "@", 1), "[^A-Za-z]", ""), F.lit("mailer"))
    local = F.concat(F.left(letters, draw(8, "local") + 1), one_of(("", "", "", "_", ".", "-"), "sign"), F.left(F.reverse(letters), draw(5, "more") + 1), F.when(draw(3, "tail") == 0, draw(99, "number").cast("string")).otherwise(""))
    host = F.concat(F.left(F.reverse(letters), draw(7, "host") + 2), one_of(("", "", "", "-shop", "7", ".mail"), "host sign"), F.lit("."), one_of(LAST_LABELS[:16], "last"))
    email = F.concat(local, F.lit("@"), host)
    return out.withColumn("match", F.when(F.col("turn") == 0, F.col("match")).when(F.col("kind") == "email", email).when(F.col("kind") == "card", card).when(F.col("kind") == "ip", ip).otherwise(turned)).drop("_shift")


def taught(spans: DataFrame, most_rows: int) -> DataFrame:
    """At most some 1.5 times most_rows labelled rows, and part, the calibrating one being 0."""
    draw = F.xxhash64("copy", "kind", "start", "end")
    least = lambda rows, n: rows.orderBy(draw, "doc_id", "gen").limit(n)
    # of each kind as many rows, however many spans are confirmed: few ones take more turns
    each = most_rows // (4 * FORMS)
    base = spans.where("base").select("doc_id", "copy", "gen", "kind", "start", "end", "match", "before", "after")
    chosen = None
    for kind in KINDS:
        own = least(base.where(F.col("kind") == kind), each)
        chosen = own if chosen is None else chosen.unionByName(own)
    chosen = materialize(chosen, "confirmed")
    found = {r[0]: r[1] for r in chosen.groupBy("kind").count().collect()}
    turns = F.coalesce(*(F.when(F.col("kind") == k, max(1, min(MOST_TURNS, each // n))) for k, n in found.items()), F.lit(1))
    made = materialize(rewritten(_turned(chosen, turns)), "rewritten")
    made = made.where(~F.col("form").isin(*HELD_FORMS)).withColumn("gen", F.concat(F.lit("made "), "form"))
    made = described(made, "label")
    vain = least(spans.where("vain and not base"), most_rows // 2).withColumn("label", F.lit(0.0))
    return made.unionByName(vain).withColumn("part", F.pmod(F.xxhash64("copy", "kind", "start", "end", "match"), F.lit(4)))


def fitted(rows: DataFrame):
    """The model, a function of rows to their scores, and the thresholds by kind."""
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="inputs")
    # a bounded number of rows of a few numbers: one task each for a hundred small jobs
    inputs = vectors.transform(rows.where("part > 0").coalesce(1).sortWithinPartitions("doc_id", "copy", "gen", "start", "match")).cache()
    model = GBTClassifier(featuresCol="inputs", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=5).fit(inputs)
    inputs.unpersist()
    return lambda found: model.transform(vectors.transform(found)).withColumn("score", vector_to_array("probability")[1])


def scored(spans: DataFrame, most_rows: int, precision: float) -> DataFrame | None:
    """Proposals that are no base spans and reach their kind's threshold, scored."""
    rows = materialize(taught(spans, most_rows), "taught")
    if rows.where("part > 0").select("label").distinct().count() < 2:
        return None
    scores = fitted(rows)
    # calibration: a row for each kind and hundredth of a score
    step = F.floor(F.col("score") * 100) / 100
    bins = scores(rows.where("part = 0")).groupBy("kind", step.alias("at")).agg(F.sum("label").alias("right"), F.count("*").alias("all"))
    above = Window.partitionBy("kind").orderBy(F.desc("at"))
    bins = bins.select("kind", "at", (F.sum("right").over(above) >= precision * F.sum("all").over(above)).alias("holds"))
    limits = bins.where("holds").groupBy("kind").agg(F.greatest(F.min("at"), F.lit(0.5)).alias("limit"))
    judged = scores(spans.where("not base and not vain")).select("doc_id", "copy", "kind", "start", "end", "score")
    return materialize(judged.join(F.broadcast(limits), "kind").where("score >= limit").drop("limit"), "judged")


def find_personal_data(documents: DataFrame, most_rows: int = MOST_ROWS, precision: float = PRECISION) -> DataFrame:
    """(doc_id, spans, base_spans) of every row; spans are arrays of structs
    (rank of the kind, start, end, kind, added), in order."""
    docs = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    spans = materialize(described(proposals(docs)), "proposals")
    sure = spans.where("base").select("doc_id", "copy", "kind", "start", "end", F.lit(2.0).alias("score"))
    extra = scored(spans, most_rows, precision)
    every = sure if extra is None else _apart(sure.unionByName(extra))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    one = F.struct(rank.alias("rank"), "start", "end", "kind", (F.col("score") < 2).alias("added"))
    by = every.groupBy("doc_id", "copy").agg(F.sort_array(F.collect_set(one)).alias("spans"))
    keys = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("copy"))
    same = keys["doc_id"].eqNullSafe(by["doc_id"]) & (keys["copy"] == by["copy"])
    out = keys.join(by, same, "left").select(keys["doc_id"], F.coalesce("spans", F.array().cast(by.schema["spans"].dataType)).alias("spans"))
    return out.withColumn("base_spans", F.filter("spans", lambda s: ~s["added"]))


def _apart(spans: DataFrame) -> DataFrame:
    """Drops added spans that overlap a base span, and then, from the highest score on
    (of the same score, from the first), those that overlap an added one that stays."""
    order = Window.partitionBy("doc_id", "copy").orderBy("start", "end", "kind", F.desc("score"))
    past, to_come = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    base = F.col("score") == 2
    clear = (F.coalesce(F.max(F.when(base, F.col("end"))).over(past), F.lit(-1)) <= F.col("start")) & (F.coalesce(F.min(F.when(base, F.col("start"))).over(to_come), F.lit(2**31 - 1)) >= F.col("end"))
    added = spans.withColumn("clear", clear).where(~base & F.col("clear")).drop("clear")
    # neighbours in order of start form runs that overlap; each is settled on its own
    fresh = F.coalesce((F.max("end").over(past) <= F.col("start")).cast("int"), F.lit(1))
    runs = added.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order)).drop("fresh")
    each = F.struct((-F.col("score")).alias("s"), "start", "end", "kind", "score")
    lists = runs.groupBy("doc_id", "copy", "run").agg(F.sort_array(F.collect_set(each)).alias("each"))
    apart = lambda kept, x: F.forall(kept, lambda k: (k["end"] <= x["start"]) | (x["end"] <= k["start"]))
    kept = F.aggregate("each", F.slice("each", 1, 0), lambda kept, x: F.when(apart(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    chosen = lists.select("doc_id", "copy", F.explode(kept).alias("k")).select("doc_id", "copy", "k.kind", "k.start", "k.end", "k.score")
    return spans.where(base).unionByName(chosen)


def digest(found: DataFrame) -> DataFrame:
    written = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(number, KINDS), F.sha2(written("base_spans"), 256).alias("base_sha256"), written("spans").alias("spans"))
