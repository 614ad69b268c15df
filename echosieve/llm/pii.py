"""Personal data by weak supervision, in DataFrame functions alone.

A scan cuts every whole text at the matches of two patterns a kind: the base one, whose
valid matches are always spans, and a loose one for what the base pattern misses (numbers
that run into each other, other separators, disguised addresses). Five labelers vote on
every match: its form, its checksum or range, a gazetteer, the words before it and the
characters around it. Expectation-maximisation (Dawid-Skene, a kind at a time) over the
counted vote patterns estimates how reliable each labeler is; its posteriors train a
logistic classifier of the votes and the span's shape, which decides about the loose
matches. Both run on counted patterns, of which a kind has at most 3^5 * 2^5 whatever the
corpus, inside one aggregation. Texts are never shuffled, only what was found in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echosieve.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive and anchored at the ends of runs, so that long runs take linear time and no recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}(?:@| ?[\[(](?:at|AT)[\])] ?)[\p{L}\p{N}-]{1,63}(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[\p{L}\p{N}-]{1,63}){1,8}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|3[47][0-9]{2}([ .-])[0-9]{6}\2[0-9]{5})(?![0-9])",
    "phone": r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])|(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}
#: What a text must hold for a pattern to be looked for, (base, loose); all but email need a digit first.
NEEDS = {"email": ("@", r"@|[\[(](?:at|AT)[\])]"), "ip": (r"[0-9]\.[0-9]", r"[0-9]\[\.\]|:[0-9A-Fa-f]{1,4}:"), "card": (r"[0-9]", r"[0-9]{4}"), "phone": (r"\+[0-9]", r"\+[0-9]|[0-9][) .-]+[0-9]{3}")}
#: A span in its usual form.
FORM = {
    "email": r"\A[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,24}\z",
    "ip": r"\A[0-9]{1,3}(?:\.[0-9]{1,3}){3}\z",
    "card": r"\A(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|3[47][0-9]{2}([ -])[0-9]{6}\2[0-9]{5})\z",
    "phone": r"\A(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}\z",
}
#: Gazetteers: (entries that speak for a span, against it), as patterns of the value.
KNOWN = {
    "email": (r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|at|ch|nl|be|pt|mx|ar|co|us|ca|br|jp|cn|in|au)\z", r"(?i)\.(?:png|jpe?g|gif|svg|css|js|html?|py|java|txt)\z"),
    "ip": (r"\A(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\[?\.", r"\A(?:0|127|255)\[?\."),
    "card": (r"\A(?:4|5[1-5]|2[2-7]|3[47]|6011|65|3[0689]|35)", r"\A[01789]"),
    "phone": (r"\A\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})|\A\(?[2-9][0-9]{2}[) .-]", r"\A(?:\+0|\(?[01])"),
}
#: Words before a span that speak for it, and against it.
WORDS = {
    "email": (r"(?:e-?mail|mail|contact|write|correo|courriel|kontakt|from|to)\W*\z", r"(?:version|git|user|host)\W*\z"),
    "ip": (r"(?:\bips?\b|ip address|address|server|host|client|login|from|adresse)\W*\z", r"(?:\bv|version|release|section|kapitel|chapter|§)\W*\z"),
    "card": (r"(?:card|credit|visa|master ?card|amex|karte|tarjeta|carte)(?: (?:no|number|nr))?\W*\z", r"(?:isbn|order|invoice|serial|tracking|id|ref|hash)\W*\z"),
    "phone": (r"(?:phone|tel|call|mobile|cell|fax|telefon|teléfono|téléphone|ruf|number)\W*\z", r"(?:isbn|order|invoice|serial|id|ref|version)\W*\z"),
}
#: CHECK is the place of the checksum or range among the labelers.
LABELERS, CHECK, BITS, EM_ROUNDS, FIT_ROUNDS, ACCEPT = 5, 1, 5, 40, 300, 0.5
#: Pseudo-counts of votes (against, none, for) of spans and of others: labelers are better than chance.
PRIOR = ((2.0, 6.0, 12.0), (12.0, 6.0, 2.0))
_ITEMS = "array<struct<kind:int,base:boolean,pos:int,gap:int,size:int,valid:boolean,left:string,value:string,right:string>>"
_MARK, _OTHER = "\x01", "\x02"


def let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


def luhn(digits: Column) -> Column:
    def add(total, k):
        d = digits.substr(-k, F.lit(1)).cast("int")
        return total + F.when(k % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column, base: bool) -> Column:
    """Whether a match passes the checks of its kind, the base pattern's or the loose one's."""
    if kind == "email":
        return F.lit(True) if base else value.rlike(r"[.\])] ?[A-Za-z]{2,24}\z")
    if kind == "ip":
        quad = F.forall(F.split(value, r"\[?\.\]?"), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
        return quad if base else F.when(F.contains(value, F.lit(":")), True).otherwise(quad)
    digits = F.translate(value, " ().+-", "")
    n = F.length(digits)
    if kind == "card":
        return F.when((n >= (14 if base else 13)) & (n <= 19), luhn(digits)).otherwise(False)
    return (n >= 10) & (n <= 15)


def _cut(text: Column, kind: str, base: bool) -> Column:
    """The matches of a pattern with what lies around them. Sizes are code points; `gap` is what
    lies between a match and the one before it. The mark doesn't occur in the text."""
    pieces = F.split(F.regexp_replace(text, (BASE if base else LOOSE)[kind], f"{_MARK}$0{_MARK}"), _MARK, -1)

    def item(p, k):
        value = p[k]
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"), F.shiftright(k, 1).alias("pos"), F.length(p[k - 1]).alias("gap"), F.length(value).alias("size"),
            valid(kind, value, base).alias("valid"), F.right(p[k - 1], F.lit(40)).alias("left"), F.left(value, F.lit(80)).alias("value"), F.left(p[k + 1], F.lit(8)).alias("right"),
        )

    none = F.array().cast(_ITEMS)
    found = let(pieces, lambda p: F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1, F.lit(2)), lambda k: item(p, k))).otherwise(none))
    return F.when(text.rlike(NEEDS[kind][0 if base else 1]), found).otherwise(none)


def evidence(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, items) of every row: all matches, null texts as empty ones."""
    text = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit(_MARK), F.lit(_OTHER))  # no pattern tells them apart
    mail, *numbers = [F.concat(*[_cut(F.col("t"), k, b) for b in (True, False)]) for k in KINDS]
    items = F.concat(mail, F.when(F.col("t").rlike("[0-9]"), F.concat(*numbers)).otherwise(F.array().cast(_ITEMS)))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("t")).select("row", "id", items.alias("items"))


def _by_kind(table: dict, column) -> Column:
    out = F.lit(None)
    for k, kind in reversed(list(enumerate(KINDS))):
        out = F.when(F.col("kind") == k, column(table[kind])).otherwise(out)
    return out


def _sign(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def votes(items: DataFrame) -> DataFrame:
    """items with the labelers' votes, -1, 0 or 1, and the shape bits the classifier sees too."""
    value, left, right = F.col("value"), F.lower("left"), F.col("right")
    form = F.when(_by_kind(FORM, value.rlike) & (F.col("size") <= 80), 1).when(F.col("base"), -1).otherwise(0)
    short = (F.col("kind") == KINDS.index("phone")) & F.length(F.translate(value, " ().+-", "")).between(7, 9)
    check = F.when(F.col("valid"), 1).when(short, 0).otherwise(-1)
    listed = _sign(_by_kind(KNOWN, lambda t: value.rlike(t[0])), _by_kind(KNOWN, lambda t: value.rlike(t[1])))
    words = _sign(_by_kind(WORDS, lambda t: left.rlike(t[0])), _by_kind(WORDS, lambda t: left.rlike(t[1])))
    glued = left.rlike(r"[\p{L}\p{N}_/=\-]\z") | right.rlike(r"\A(?:[\p{L}\p{N}_=/]|[.\-:][0-9])")
    around = _sign(left.rlike(r"(?:\A|[\s,;:.(\[<\"'])\z") & right.rlike(r"\A(?:\z|[\s,;:.!?)\]>\"'])"), glued)
    bits = [value.rlike("[ ]"), value.rlike(r"[().\[\]-]"), F.col("base"), F.col("size").between(7, 40), F.size(F.array_distinct(F.split(value, ""))) >= 5]
    return items.withColumn("votes", F.array(*[v.cast("int") for v in (form, check, listed, words, around)])).withColumn("bits", F.array(*[b.cast("int") for b in bits]))


def dot(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def weighted(patterns: Column, weights: Column, field: str, zero: Column) -> Column:
    """The sum over patterns of weight times the pattern's vector."""
    return F.aggregate(F.arrays_zip(patterns.alias("p"), weights.alias("w")), zero, lambda s, r: F.zip_with(s, r["p"][field], lambda a, v: a + r["w"] * v))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def em(patterns: Column, rounds: int = EM_ROUNDS) -> Column:
    """Posterior that a pattern is a span, by a two-class model with independent labelers.
    `patterns` is an array of (n, x, z), x one 0/1 entry for each labeler and vote. It begins
    from the votes' sign and keeps PRIOR as pseudo-counts. What fails its kind's check is known
    not to be a span."""
    size, strength = 3 * LABELERS, sum(PRIOR[0])
    constants = [F.array(*[F.lit(p) for _ in range(LABELERS) for p in side]) for side in PRIOR]
    total = F.aggregate(patterns, F.lit(0.0), lambda s, p: s + p["n"])

    def posterior(weights, bias):
        return F.transform(patterns, lambda p: F.when(p["x"][3 * CHECK] == 1, 0.0).otherwise(sigmoid(bias + dot(p["x"], weights))))

    def step(state, _):
        def maximise(mass):
            n1 = F.aggregate(mass, F.lit(0.0), lambda s, v: s + v)
            s1 = weighted(patterns, mass, "x", zeros(size))
            rest = F.zip_with(patterns, mass, lambda p, m: p["n"] - m)
            s0 = weighted(patterns, rest, "x", zeros(size))
            log = lambda s, prior, n: F.zip_with(s, prior, lambda a, b: F.log((a + b) / (n + strength)))
            weights = F.zip_with(log(s1, constants[0], n1), log(s0, constants[1], total - n1), lambda a, b: a - b)
            return F.struct(weights.alias("w"), F.log((n1 + 1.0) / (total - n1 + 1.0)).alias("b"))

        return let(F.zip_with(patterns, posterior(state["w"], state["b"]), lambda p, y: p["n"] * y), maximise)

    first = F.struct(F.array(*[F.lit(float(v)) for _ in range(LABELERS) for v in (-1, 0, 1)]).alias("w"), F.lit(0.0).alias("b"))
    return let(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step), lambda s: posterior(s["w"], s["b"]))


def logistic(patterns: Column, soft: Column, rounds: int = FIT_ROUNDS, ridge: float = 1.0) -> Column:
    """Weights of a logistic regression on z with the soft labels. Every step minimises a bound
    of the penalised loss, so it never rises."""
    size = LABELERS + BITS + 1
    squares = F.aggregate(patterns, zeros(size), lambda s, p: F.zip_with(s, p["z"], lambda a, v: a + p["n"] * v * v))

    def run(curve, rows):
        def step(w, _):
            error = F.transform(rows, lambda r: r["p"]["n"] * (sigmoid(dot(r["p"]["z"], w)) - r["y"]))
            return let(error, lambda e: F.zip_with(w, F.zip_with(F.zip_with(weighted(patterns, e, "z", zeros(size)), w, lambda g, v: g + ridge * v), curve, lambda g, c: g / c), lambda v, d: v - d))

        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), zeros(size), step)

    pairs = F.arrays_zip(patterns.alias("p"), soft.alias("y"))
    return let(F.transform(squares, lambda q: q * (size / 4.0) + ridge), lambda curve: let(pairs, lambda rows: run(curve, rows)))


def anchors(patterns: Column) -> Column:
    """Two patterns that stand for what all labelers say yes and no to, a tenth of the items
    each, so that a kind without counterexamples still turns on its votes."""
    n = F.aggregate(patterns, F.lit(0.0), lambda s, p: s + p["n"]) * 0.1
    return F.array(*[F.struct(n.alias("n"), zeros(3 * LABELERS).alias("x"), F.array(*[F.lit(v) for v in [sign] * LABELERS + [0.5] * BITS + [1.0]]).alias("z")) for sign in (1.0, -1.0)])


def shape(votes: Column, bits: Column) -> Column:
    """The classifier's vector: votes, bits and a constant."""
    return F.concat(votes.cast("array<double>"), bits.cast("array<double>"), F.array(F.lit(1.0)))


def train(items: DataFrame) -> DataFrame:
    """(kind, weights): one row a kind that has items."""
    one_hot = F.flatten(F.transform("votes", lambda v: F.array(*[(v == k).cast("double") for k in (-1, 0, 1)])))
    counted = items.groupBy("kind", "votes", "bits").agg(F.count("*").cast("double").alias("n"))
    patterns = F.array_sort(F.collect_list(F.struct("n", one_hot.alias("x"), shape(F.col("votes"), F.col("bits")).alias("z"))))
    per_kind = counted.groupBy("kind").agg(patterns.alias("patterns"))
    fit = let(F.concat("patterns", anchors(F.col("patterns"))), lambda both: let(F.concat(em(F.col("patterns")), F.array(F.lit(1.0), F.lit(0.0))), lambda soft: logistic(both, soft)))
    return per_kind.select("kind", fit.alias("weights"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "pii") -> DataFrame:
    """(id_col, base, spans) of every row: arrays of (start, kind, end, score) by start and
    kind, kind as its place in KINDS, in code points with the end exclusive. `base` has
    the valid matches of the base patterns with score 1; `spans` has these and the loose
    matches that pass their kind's check and that the classifier takes, the most likely one of those that overlap and none
    that overlaps a base span. Null and empty texts have none; repeated rows, null ids and
    long texts are rows like others; columns not named are ignored."""
    scratch = Scratch(docs.sparkSession, label)
    seen = scratch.save(evidence(docs, id_col, text_col), "evidence")
    items = seen.select("row", F.explode("items").alias("i")).select("row", "i.*")
    along = W.partitionBy("row", "kind", "base").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    items = items.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(along)).withColumn("start", F.col("end") - F.col("size"))
    sure = F.col("base") & F.col("valid")
    keys = ("start", "end", "kind", "base")  # running frames in either direction take one step a row
    ahead, back = (W.partitionBy("row").orderBy(*[o(c) for c in keys]).rowsBetween(W.unboundedPreceding, -1) for o in (F.asc, F.desc))
    before, after = F.max(F.when(sure, F.col("end"))).over(ahead), F.min(F.when(sure, F.col("start"))).over(back)
    free = ~(F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False)))
    items = votes(items.withColumn("sure", sure).withColumn("free", free).where("sure or free"))
    items = scratch.save(items.select("row", "kind", "start", "end", "sure", "votes", "bits"), "items")
    model = train(items)  # a row a kind
    scored = items.where("not sure").join(F.broadcast(model), "kind").withColumn("score", sigmoid(dot(shape(F.col("votes"), F.col("bits")), F.col("weights"))))
    scored = scored.where((F.col("score") >= ACCEPT) & (F.col("votes")[CHECK] >= 0)).select("row", "kind", "start", "end", "score")
    order = W.partitionBy("row").orderBy("start", "end", "kind", "score")
    apart = F.coalesce(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)) <= F.col("start"), F.lit(True))
    clump = F.sum(F.col("apart").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    best = F.max_by(F.struct("start", "kind", "end", "score"), F.struct("score", -F.col("start"), "end", -F.col("kind")))
    added = scored.withColumn("apart", apart).withColumn("clump", clump).groupBy("row", "clump").agg(best.alias("s")).select("row", "s.*", F.lit(False).alias("sure"))
    both = added.unionByName(items.where("sure").select("row", "start", "kind", "end", F.lit(1.0).alias("score"), "sure"))
    span = F.struct(F.col("start").cast("long").alias("start"), "kind", F.col("end").cast("long").alias("end"), "score")
    own = both.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("sure"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,score:double>>")
    return seen.select("row", F.col("id").alias(id_col)).join(own, "row", "left").select(id_col, F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def how_many(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the
    first one counts."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])

    def put(state, s):
        cut = F.concat(state["out"], text.substr(state["at"] + 1, (s["start"] - state["at"]).cast("int")), F.get(names, s["kind"]))
        return F.when(s["start"] < state["at"], state).otherwise(F.struct(cut.alias("out"), s["end"].cast("int").alias("at")))

    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(spans, begin, put, lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text))))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are those of the base spans."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), label="op12")
    return found.select("doc_id", *[how_many(F.col("base"), kind).alias(f"n_{kind}") for kind in KINDS], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
