"""Personal data: rule-based spans, and candidates that a gradient-boosted model accepts.

All work on documents is done by SQL functions; the model's trees become an
expression, so that scoring needs neither Python nor a shuffle.  The model
learns from written examples with known spans, real and misleading ones,
which SQL functions make up as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.rows import named, packed, unpacked
from rankweave.llm.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")

#: The base forms.  Runs are possessive, and start where a run starts or the last match ended, so that
#: long runs take linear time; they match what the plain forms match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators, whose spans overlap: forms with other separators, spelled-out signs, or no plus, in wide and narrow cuts.
#: Their bounds are those of the formats (64 and 63 characters in parts of an address; numbers of 6 to 26 places), not of texts.
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,4}"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}){1,4}"),
    ("ip", r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3,5}(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9A-Za-z])[0-9](?:[\x20.-]{0,2}[0-9]){11,25}(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{4}(?:([\x20.-])[0-9]{4})(?:\1[0-9]{4})(?:\1[0-9]{4})(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z])(?:\+|\()?[0-9][0-9().\x20/-]{5,24}[0-9](?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{2,8}(?:[\x20.-][0-9]{2,8}){0,3}(?![0-9A-Za-z])"),
)
# --- Fixed values: words before a number that speak for or against personal data ---
FOR_WORDS = "phone tel telefon call mobile fax mail contact write card visa mastercard pay karte carte tarjeta ip host address server client".split()
AGAINST_WORDS = "order invoice version section isbn serial date ref total between page build item article chapter until room figure".split()
CONTEXT, DECOY = (r"(?i)\b(" + "|".join(words) + r")\b" for words in (FOR_WORDS, AGAINST_WORDS))

#: Characters before a candidate that are its context.
CONTEXT_CHARS = 48
#: Written examples that the model is fitted on; a fourth of them is held out for the thresholds.
EXAMPLES = 6000
TREES, DEPTH = 20, 3
#: A kind's threshold is the least score above which held-out candidates are right this often.
PRECISION = 0.98

#: Matches whose places are added up together.
BLOCK = 256

FEATURES = ("kind", "digits", "signs", "length", "groups", "longest", "shortest", "checksum", "small_parts", "parens", "dots", "plus", "zero", "at", "distinct", "context", "decoy", "glued", "letters")


#: What an address with a spelled-out sign holds.
SPELLED = r"[\[(]at[\])]|\x20dot\x20|\x20at\x20[A-Za-z0-9-]+\.[A-Za-z]"


def can_match(text: Column, kind: str, wide: bool = False) -> Column:
    """A cheap test that every text with a match of a rule (or of a generator) passes."""
    if kind == "email":
        sign = F.contains(text, F.lit("@"))
        return sign | ((F.contains(text, F.lit("at")) | F.contains(text, F.lit(" dot "))) & F.regexp(text, F.lit(SPELLED))) if wide else sign
    return F.regexp(text, F.lit("[0-9]")) if wide or kind != "phone" else F.contains(text, F.lit("+"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; inside of functions of arrays other expressions are computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str, there: Column, keep) -> Column:
    """Leftmost non-overlapping matches that ``keep`` accepts: array of (start, end, match, before, after), in code points; none unless ``there``.

    Places are added up in blocks of BLOCK matches, so that a text with very
    many of them never has a long array copied for each.
    """
    none = F.array().cast("array<struct<start:int,end:int,match:string,before:string,after:string>>")

    def block(s: Column, b: Column, at: Column) -> Column:
        def add(a: Column, i: Column) -> Column:
            match, piece = F.get(s["found"], i), F.get(s["pieces"], i)
            start = a["at"] + F.length(piece)
            here = F.struct(start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match"), F.right(piece, F.lit(CONTEXT_CHARS)).alias("before"), F.left(F.get(s["pieces"], i + 1), F.lit(1)).alias("after"))
            return F.struct((start + F.length(match)).alias("at"), F.when(keep(match), F.array_append(a["out"], here)).otherwise(a["out"]).alias("out"))

        return F.aggregate(F.sequence(b * BLOCK, F.least((b + 1) * BLOCK, F.size(s["found"])) - 1), F.struct(at.alias("at"), none.alias("out")), add, lambda a: a["out"])

    def starts(s: Column) -> Column:
        """Where each block begins."""
        size = lambda total, i: total + F.length(F.get(s["found"], i)) + F.length(F.get(s["pieces"], i))
        whole = F.filter(F.sequence(F.lit(0), F.size(s["found"]).cast("int")), lambda i: (i + 1) * BLOCK < F.size(s["found"]))
        return F.aggregate(
            whole,
            F.array(F.lit(0)),
            lambda out, b: F.array_append(out, F.aggregate(F.sequence(b * BLOCK, (b + 1) * BLOCK - 1), F.element_at(out, -1), size)),
        )

    split = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces"))
    placed = let(split, lambda s: F.flatten(F.transform(starts(s), lambda at, b: block(s, b, at))))
    return F.when(there & F.regexp(text, F.lit(pattern)), placed).otherwise(none)


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, -i, F.lit(1))) - 48
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def luhn(digits: Column) -> Column:
    """Whether the digits' checksum holds."""
    return luhn_sum(digits) % 10 == 0


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def valid(kind: str, match: Column) -> Column:
    """The base rule of a kind."""
    n = F.length(digits_of(match))
    if kind == "ip":
        return F.regexp(match, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits_of(match))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans by the base rules: array of (start, kind, end)."""

    def of(k: int, kind: str) -> Column:
        good = matches(text, BASE[kind], can_match(text, kind), lambda m: valid(kind, m))
        return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")))

    return F.concat(*(of(k, kind) for k, kind in enumerate(KINDS)))


def candidate_features(text: Column) -> Column:
    """All candidates of all generators, with their features."""

    def described(k: int, m: Column) -> Column:
        match, digits = m["match"], digits_of(m["match"])
        n = F.length(digits)
        runs = F.filter(F.split(match, "[^0-9]+"), lambda x: F.length(x) > 0)
        sizes = F.transform(runs, lambda x: F.length(x))
        values = {
            "kind": F.lit(k),
            "digits": F.least(n, F.lit(30)),
            "signs": F.least(F.length(F.regexp_replace(match, r"[0-9A-Za-z+]", "")), F.lit(12)),
            "length": F.least(F.length(match), F.lit(40)),
            "groups": F.least(F.size(runs), F.lit(8)),
            "longest": F.least(F.coalesce(F.array_max(sizes), F.lit(0)), F.lit(20)),
            "shortest": F.least(F.coalesce(F.array_min(sizes), F.lit(0)), F.lit(20)),
            "checksum": F.when(n > 0, luhn(digits)).otherwise(False).cast("int"),
            "small_parts": F.regexp(match, F.lit(rf"^{_PART}(?:\[?\.\]?{_PART}){{3}}$")).cast("int"),
            "parens": F.regexp(match, F.lit(r"\([0-9]{1,5}\)")).cast("int"),
            "dots": F.least(F.regexp_count(match, F.lit(r"(?i)\.|\bdot\b")), F.lit(6)),
            "plus": F.contains(match, F.lit("+")).cast("int"),
            "zero": F.regexp(match, F.lit(r"^\(?0")).cast("int"),
            "at": F.when(F.contains(match, F.lit("@")), 2).when(F.regexp(match, F.lit(r"[\[(]at[\])]")), 1).otherwise(0),
            "distinct": F.size(F.array_distinct(F.split(digits, ""))),
            "context": F.regexp(m["before"], F.lit(CONTEXT)).cast("int"),
            "decoy": F.regexp(m["before"], F.lit(DECOY)).cast("int"),
            "glued": (F.regexp(m["before"], F.lit("[0-9A-Za-z._-]$")) | F.regexp(m["after"], F.lit("^[0-9A-Za-z_]"))).cast("int"),
            "letters": F.least(F.length(F.regexp_replace(match, r"[^A-Za-z]", "")), F.lit(30)),
        }
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), *(values[f].cast("double").alias(f) for f in FEATURES))

    def of(kind: str, pattern: str) -> Column:
        k = KINDS.index(kind)
        return F.transform(matches(text, pattern, can_match(text, kind, wide=True), lambda m: F.lit(True)), lambda m: described(k, m))

    return F.concat(*(of(kind, pattern) for kind, pattern in GENERATORS))


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """Written texts with one number or address each: text, start and end of it, kind, whether it is personal data, and held_out.

    Forms, words before it and digits are drawn by hashes of the row's number;
    a third of both sides stands without a telling word, and a tenth after a misleading one.
    """
    i = F.col("id")
    draw = lambda seed, most: F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(most))
    digits = lambda seed, size: F.lpad(draw(seed, 10**size).cast("string"), size, "0")
    part = lambda seed: draw(seed, 256).cast("string")
    name = lambda seed, size: F.translate(F.substring(F.md5(F.concat(i.cast("string"), F.lit(f":{seed}"))), 1, size), "0123456789", "ghijklmnop")
    any_size = lambda seed: F.substring(name(seed, 16), F.lit(1), (draw(seed + 100, 13) + 2).cast("int"))
    one_of = lambda seed, *xs: F.element_at(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in xs)), (draw(seed, len(xs)) + 1).cast("int"))
    join = lambda *xs: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in xs))

    body = join("4", digits(20, 14))
    check = F.pmod(10 - luhn_sum(join(body, "0")) % 10, F.lit(10)).cast("string")
    card, wrong = join(body, check), join(body, F.pmod(check.cast("int") + 1 + draw(21, 9), F.lit(10)).cast("string"))
    grouped = lambda x, sign: F.regexp_replace(x, "([0-9]{4})(?=[0-9])", f"$1{sign}")
    user, host, top = one_of(1, name(2, 6), join(name(3, 5), ".", name(4, 7)), join(name(5, 4), digits(6, 2))), name(7, 8), one_of(8, "com", "org", "net", "de", "co.uk")
    real = {
        "email": (join(user, "@", host, ".", top), join(user, " (at) ", host, ".", top), join(user, "[at]", host, "[dot]", top), join(user, " at ", host, " dot ", top), join(user, " (at) ", host, " (dot) ", top)),
        "ip": (join(part(9), ".", part(10), ".", part(11), ".", part(12)), join(part(9), "[.]", part(10), "[.]", part(11), "[.]", part(12))),
        "card": (card, grouped(card, " "), grouped(card, "-"), grouped(card, ".")),
        "phone": (
            join("+", digits(13, 2), " ", digits(14, 3), " ", digits(15, 6)), join("+1 (", digits(13, 3), ") ", digits(14, 3), "-", digits(15, 4)),
            join("(0", digits(13, 2), ") ", digits(14, 4), " ", digits(15, 4)), join("0", digits(13, 2), "-", digits(14, 4), "-", digits(15, 4)),
            join("0", digits(13, 3), "/", digits(14, 7)), join("0", digits(13, 2), " ", digits(14, 4), " ", digits(15, 4)), join("555-", digits(14, 3), "-", digits(15, 4)),
        ),
    }
    false = {
        "email": (join(user, "@", host), join(any_size(2), " at ", any_size(7)), join("@", any_size(7)), join(any_size(2), " at ", any_size(7), "."), join(any_size(2), ". ", any_size(7), " at ", any_size(3))),
        "ip": (
            join(digits(9, 3), ".", part(10), ".", (draw(11, 700) + 256).cast("string"), ".", part(12)), join(digits(9, 1), ".", digits(10, 1), ".", digits(11, 2), ".", digits(12, 1), ".", digits(13, 1)),
            join(digits(9, 1), ".", digits(10, 1), ".", digits(11, 1), ".", digits(12, 1), ".", digits(13, 1), ".", digits(14, 1)),
        ),
        "card": (wrong, grouped(wrong, " "), digits(20, 16), join("978-", digits(22, 1), "-", digits(23, 2), "-", digits(24, 6), "-", digits(25, 1)), digits(20, 13), join(digits(20, 12), digits(21, 9)), grouped(wrong, "-")),
        "phone": (
            join("20", digits(13, 2), "-0", (draw(14, 9) + 1).cast("string"), "-1", digits(15, 1), " 1", digits(16, 1)), join(digits(13, 1), " ", digits(14, 3), " ", digits(15, 3), " ", digits(16, 3)),
            join("19", digits(13, 2), "-20", digits(14, 2)), join("1", digits(13, 1), ".0", digits(14, 1), ".20", digits(15, 2)), join(digits(13, 3), ".", digits(14, 3), ".", digits(15, 3)), digits(13, 8), digits(13, 16),
            join(digits(13, 2), "-", digits(14, 3), "-", digits(15, 2)), join(digits(13, 4), " ", digits(14, 4), " ", digits(15, 4)), join("1", digits(14, 9)),
        ),
    }
    by_kind = lambda seed, forms: F.element_at(F.array(*(one_of(seed, *forms[kind]) for kind in KINDS)), F.col("kind") + 1)
    telling = F.when(F.col("personal") == (draw(31, 10) > 0), one_of(32, *FOR_WORDS)).otherwise(one_of(32, *AGAINST_WORDS))
    before = F.when(draw(33, 3) == 0, join(name(34, 3), " ", name(35, 7))).otherwise(join(name(34, 5), " ", telling, one_of(36, "", ":", " no.", " is")))
    made = (
        spark.range(0, n, numPartitions=1)
        .select("id", (draw(30, len(KINDS))).cast("int").alias("kind"), (draw(37, 2) == 0).alias("personal"), (F.col("id") % 4 == 0).alias("held_out"))
        .withColumns({"before": join(before, " "), "span": F.when(F.col("personal"), by_kind(38, real)).otherwise(by_kind(39, false))})
    )
    return made.select(
        "kind", "personal", "held_out",
        join(F.col("before"), F.col("span"), one_of(40, "", ".", ", ", " and "), " ", name(41, 6), " ", name(42, 3)).alias("text"),
        F.length("before").alias("from"), (F.length("before") + F.length("span")).alias("to"),
    )


class Scorer:
    """Boosted trees and a threshold for each kind, as expressions over a candidate's fields."""

    def __init__(self, trees: list[tuple[float, object]], thresholds: dict[int, float]):
        self.trees, self.thresholds = trees, thresholds

    def margin(self, candidate) -> Column:
        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            feature, threshold, low, high = node
            return F.when(candidate[FEATURES[feature]] <= threshold, walk(low)).otherwise(walk(high))

        return reduce(lambda a, b: a + b, [walk(root) * F.lit(weight) for weight, root in self.trees], F.lit(0.0))

    def excess(self, candidate) -> Column:
        """How far a candidate's score is above the threshold of its kind; null if the kind has none."""
        if not self.trees or not self.thresholds:
            return F.lit(None).cast("double")
        least = reduce(lambda e, x: F.when(candidate["kind"] == x[0], F.lit(x[1])).otherwise(e), self.thresholds.items(), F.lit(None).cast("double"))
        return self.margin(candidate) - least


def tree_of(node) -> object:
    """A fitted tree as nested (feature, threshold, low side, high side) and leaf values."""
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), tree_of(node.leftChild()), tree_of(node.rightChild())


def train(spark: SparkSession, n: int = EXAMPLES) -> Scorer:
    """Fit on the candidates of ``n`` written examples: those that are exactly a personal span are right, all others wrong.

    Equal feature rows are counted, so the model is fitted on distinct rows with
    weights.  Of each kind's held-out candidates the scores give the threshold;
    a kind that never reaches the precision takes no candidate.
    """
    found = examples(spark, n).select("personal", "held_out", F.col("kind").alias("of"), "from", "to", F.explode(candidate_features(F.col("text"))).alias("c"))
    right = F.col("personal") & (F.col("of") == F.col("c.kind")) & (F.col("from") == F.col("c.start")) & (F.col("to") == F.col("c.end"))
    labelled = found.select(right.cast("int").alias("label"), "held_out", *(F.col(f"c.{f}").alias(f) for f in FEATURES))
    counted = Scratch(spark).keep(labelled.groupBy("label", "held_out", *FEATURES).agg(F.count("*").cast("double").alias("weight")).coalesce(1), "features")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(counted.where("NOT held_out")).withColumn("label", F.col("label").cast("double"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, weightCol="weight", seed=7, maxBins=64).fit(rows.select("label", "features", "weight"))
    trees = [(float(w), tree_of(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees, strict=True)]
    scorer = Scorer(trees, {})
    scores = (
        counted.where("held_out").select("kind", "label", "weight", F.floor(scorer.margin({f: F.col(f) for f in FEATURES}) * 20).alias("bin"))
        .groupBy("kind", "bin").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("good"))
        .orderBy("kind", F.col("bin").desc()).collect()
    )  # at most a few hundred bins: margins are bounded by the trees
    for kind in range(len(KINDS)):
        total = good = 0.0
        for r in (r for r in scores if int(r["kind"]) == kind):
            total, good = total + r["n"], good + r["good"]
            if good >= PRECISION * total and r["good"] > 0:
                scorer.thresholds[kind] = float(r["bin"]) / 20
    return scorer


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, scorer: Scorer, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add ``base`` and ``spans`` to the columns ``carry`` of ``docs`` (all by default; equal names, in any case, are replaced).

    Both are arrays of (start, kind, end), kind being an index of KINDS, in
    code points, in order of start and kind.  ``base`` has what the base rules
    find; ``spans`` also the candidates that the model accepts outside of base
    spans, the best-scored of overlapping ones.  A null or empty text has no
    spans; no rows give no rows, repeated rows stay.
    """
    work = docs.select(packed(docs, ("base", "spans"), carry).alias("row"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    work = work.withColumn("base", F.array_sort(base_spans(F.col("text"))))
    shape = "array<struct<start:int,more:boolean,kind:int,end:int,score:double>>"
    struct = lambda start, more, kind, end, score: F.struct(start.alias("start"), more.alias("more"), kind.cast("int").alias("kind"), end.alias("end"), score.alias("score"))
    scored = F.transform(candidate_features(F.col("text")), lambda c: struct(c["start"], F.lit(True), c["kind"], c["end"], scorer.excess(c)))
    work = work.withColumn("more", F.filter(scored, lambda c: c["score"] >= 0))
    both = F.array_sort(F.concat(F.transform("base", lambda b: struct(b["start"], F.lit(False), b["kind"], b["end"], F.lit(0.0))), F.col("more")))

    def add(a: Column, x: Column) -> Column:
        last = F.get(a["out"], F.size(a["out"]) - 1)
        meets = F.coalesce(last["more"] & (last["end"] > x["start"]), F.lit(False))  # a candidate taken before
        replaced = F.array_append(F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1), x)
        taken = F.when(meets, F.when(~x["more"] | (x["score"] > last["score"]), replaced).otherwise(a["out"])).otherwise(F.array_append(a["out"], x))
        return F.struct(
            F.when(x["more"] & (x["start"] < a["upto"]), a["out"]).otherwise(taken).alias("out"),
            F.when(x["more"], a["upto"]).otherwise(F.greatest(a["upto"], x["end"])).alias("upto"),
        )

    chosen = F.aggregate(both, F.struct(F.array().cast(shape).alias("out"), F.lit(0).alias("upto")), add, lambda a: a["out"])
    spans = F.array_sort(F.transform(chosen, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    out = work.withColumn("spans", F.when(F.size("more") > 0, spans).otherwise(F.col("base")))
    return out.select(*unpacked(out), "base", "spans")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span (overlapping ones together) replaced by its kind in angle brackets."""
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= a["at"],
                F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"]))),
            ).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
