"""Personal data: generators propose spans, boosted trees weigh them, calibrated thresholds select.

Fixed patterns give the base spans, which always stay. Wider patterns propose further candidates of the same kinds, and of
secrets (keys and tokens), in what the base spans leave of the text. Trees over format and context features weigh them.

A candidate that fails its kind's check (parts of at most 255, Luhn, 9 to 15 digits, a top-level domain, letters and
digits) is never added; the trees decide on the rest. They learn from a bounded sample of documents, from spans whose label
doesn't rest on the base patterns. Positive are valid spans in other clothes (a phone without plus or with other separators,
a written-out at, a masked point, a card with points or slashes, a key behind a word that announces it) that the wider
patterns find again in their context. Negative are the same numbers dealt into the groups of dates, amounts and times, and
keys without such a word. The valid spans are those of the sample and as many made ones of each kind, set into the
sample's texts, so that a small table fits as well as a large one. Candidates of the texts themselves have no label and
aren't used, but for keys. For each kind the threshold is the least score from which on every bin of held-out spans has the
wanted precision.

DataFrame functions only. All spans of a text are found and scored within its row: the fitted
trees become one expression, and no row is exchanged.
"""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans: the base kinds, and one that only the method finds.
ADDED = (*KINDS, "secret")
_LOCAL = "A-Za-z0-9._%+-"
_LABEL = "[A-Za-z0-9-]++"
# The base patterns, with possessive repetition (nothing that follows could need less) and
# starts only where a run starts or the last match ended: the same matches, found in linear time.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@{_LABEL}(?:\.{_LABEL})++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++(?:\x20?@\x20?{_LABEL}(?:\.{_LABEL})*+|\x20?[\[(]at[\])]\x20?{_LABEL}(?:(?:\.|\x20?[\[(]dot[\])]\x20?){_LABEL})++)",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:[.:]|\[\.\])[0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])\+?\(?[0-9]{1,4}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,4}\)?){2,4}(?![0-9])",
    "secret": r"(?<![0-9A-Za-z_/+-])[0-9A-Za-z_/+-]{20,}+={0,2}",
}
#: A text without this isn't searched for the kind.
NEEDS = {"email": r"@|[\[(]at[\])]", "ip": r"[0-9A-Fa-f](?:[.:]|\[\.\])[0-9A-Fa-f]", "card": r"[0-9]", "phone": r"[0-9][\x20().0-9/-]", "secret": r"(?<![0-9A-Za-z_/+-])[0-9A-Za-z_/+-]{20}"}
#: Words that announce a kind.
CUES = {"email": "mail|contact|write|@", "ip": "ip|host|server|addr", "card": "card|visa|credit|pay|iban|account", "phone": "tel|phone|call|fax|mobile|contact", "secret": "token|secret|key|passw|auth|bearer|credential"}
#: What takes the place of base spans in the text that the wider patterns see; no pattern has it.
_MASK = "\x02"
_BLOCK = 64
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
FEATURES = ("kind", "length", "digits", "signs", "groups", "plus", "at", "dots", "spaces", "parens", "distinct", "glued_before", "glued_after", "cue", "capital", "luhn", "parts", "last", "letters", "upper")

#: Bounds of the fit: documents sampled, spans made of each kind, candidates used.
SAMPLE_DOCUMENTS = 4000
MADE_SPANS = 400
SAMPLE_CANDIDATES = 16_000
TREES, DEPTH = 12, 3
PRECISION = 0.95
LEAST_SUPPORT = 20


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    """Whether a match of the base pattern passes the kind's check."""
    n = F.length(x["digits"])
    if kind == "ip":
        return x["match"].rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(x["digits"])).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _span_at(parts: Column, ends: Column) -> Callable[[Column], Column]:
    def span(i: Column) -> Column:
        match = F.element_at(parts, i)
        return F.struct(
            match.alias("match"), F.regexp_replace(match, "[^0-9]", "").alias("digits"),
            F.right(F.element_at(parts, i - 1), F.lit(24)).alias("before"), F.left(F.element_at(parts, i + 1), F.lit(12)).alias("after"),
            F.element_at(ends, i).alias("start"), F.element_at(ends, i + 1).alias("end"),
        )

    return span


def _running(lengths: str) -> Column:
    """The sums before each element of a column, and of all, block by block, so that a text with very many matches stays cheap."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)), F.lit(_BLOCK))

    def block(acc: Column, at: Column) -> Column:
        sums = F.aggregate(F.slice(lengths, at + 1, F.lit(_BLOCK)), F.array(F.element_at(acc, -1)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return F.concat(acc, F.slice(sums, 2, _BLOCK))

    return F.aggregate(starts, F.array(F.lit(0).cast("long")), block)


def _parts(text: str, kind: str, pattern: str) -> Column:
    """A text in parts, matches and what is between in turn, beginning with the latter. Matches are marked with two
    control characters, which are no part of any pattern."""
    return F.when(F.col(f"_has_{kind}"), F.split(F.regexp_replace(text, pattern, "\x01$0\x01"), "\x01", -1)).otherwise(F.array(text))


def _spans(docs: DataFrame, parts: dict[str, str], prefix: str) -> DataFrame:
    """``docs`` with an array of matches for each kind: match, digits, before, after, start, end; ``parts``: kind to column."""
    # lengths and ends are columns of their own with two uses each, so that Spark doesn't compute them anew for each match
    docs = docs.withColumns({f"{name}_long": F.transform(name, lambda p: F.length(p).cast("long")) for name in parts.values()})
    docs = docs.withColumns({f"{name}_ends": _running(f"{name}_long") for name in parts.values()})
    for kind, name in parts.items():
        places = F.when(F.size(name) > 2, F.sequence(F.lit(2), F.size(name) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
        docs = docs.withColumn(f"{prefix}{kind}", F.transform(places, _span_at(F.col(name), F.col(f"{name}_ends"))))
    return docs.drop(*[x for name in parts.values() for x in (name, f"{name}_long", f"{name}_ends")])


def _masked(parts: str, kind: str, text: str) -> Column:
    """The text of ``parts`` with its valid matches masked, as long as it was."""

    def one(part: Column, i: Column) -> Column:
        x = F.struct(part.alias("match"), F.regexp_replace(part, "[^0-9]", "").alias("digits"))
        return F.when((i % 2 == 1) & _valid(kind, x), F.repeat(F.lit(_MASK), F.length(part))).otherwise(part)

    return F.when(F.size(parts) == 1, F.col(text)).otherwise(F.array_join(F.transform(parts, one), ""))


def _features(kind: str, x: Column) -> dict[str, Column]:
    match, digits = x["match"], x["digits"]

    def count(signs: str) -> Column:
        return F.length(match) - F.length(F.regexp_replace(match, signs, ""))

    values = {
        "kind": F.lit(ADDED.index(kind)), "length": F.length(match), "digits": F.length(digits), "signs": count("[^0-9A-Za-z]"), "groups": F.regexp_count(match, F.lit("[0-9]+")),
        "plus": match.startswith("+"), "at": match.contains("@"), "dots": count("[.]"), "spaces": count(" "), "parens": count("[()]"),
        "distinct": F.size(F.array_distinct(F.split(digits, ""))), "glued_before": x["before"].rlike("[0-9A-Za-z]$"), "glued_after": x["after"].rlike("^[0-9A-Za-z]"),
        "cue": F.lower(x["before"]).rlike(CUES[kind]), "capital": x["before"].rlike("[A-Z][A-Za-z]*[^A-Za-z]*$"), "luhn": _luhn(digits) if kind == "card" else F.lit(0),
        "parts": F.regexp_replace(match, r"[\[\]]", "").rlike(rf"^{_PART}([.:]{_PART}){{3}}$") if kind == "ip" else F.lit(0), "last": F.length(F.regexp_extract(match, "([0-9]+)[^0-9]*$", 1)),
        "letters": F.regexp_count(match, F.lit("[A-Za-z]")), "upper": F.regexp_count(match, F.lit("[A-Z]")),
    }
    return {k: values[k].cast("double") for k in FEATURES}


def find_candidates(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with base_<kind> (valid base spans) and wide_<kind> (candidates clear of them)."""
    names = {x: [f"_{x}_{k}" for k in ADDED] for x in ("base", "left", "wide")}
    docs = docs.withColumn("_clean", F.translate(F.coalesce(F.col(text_col), F.lit("")), "\x01\x02", "\x03\x03"))
    docs = docs.withColumns({f"_has_{k}": F.col("_clean").rlike(p) for k, p in NEEDS.items()})
    docs = docs.withColumns({f"_base_{k}": _parts("_clean", k, p) for k, p in BASE.items()})
    docs = docs.withColumn("_left_email", _masked("_base_email", "email", "_clean"))
    for before, kind in itertools.pairwise(KINDS):
        docs = docs.withColumn(f"_cut_{kind}", _parts(f"_left_{before}", kind, BASE[kind])).withColumn(f"_left_{kind}", _masked(f"_cut_{kind}", kind, f"_left_{before}"))
    docs = docs.withColumns({f"_wide_{k}": _parts(f"_left_{KINDS[-1]}", k, p) for k, p in WIDE.items()})
    found = _spans(docs, {k: f"_base_{k}" for k in KINDS}, "base_")
    found = _spans(found, {k: f"_wide_{k}" for k in ADDED}, "wide_").drop("_clean", *names["left"], *[f"_cut_{k}" for k in KINDS], *[f"_has_{k}" for k in ADDED])
    return found.withColumns({f"base_{k}": F.filter(f"base_{k}", partial_of(_valid, k)) for k in KINDS})


def partial_of(function: Callable[..., Column], *given: object) -> Callable[[Column], Column]:
    """A lambda of one argument (Spark counts the parameters), the others given."""
    return lambda x: function(*given, x)


def _place(kind: str, x: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), x["start"], F.lit(":"), x["end"])


def _known(kind: str, x: Column) -> Column:
    return F.struct(F.lit(kind).alias("name"), x.alias("x"))


def _named(kind: str, x: Column) -> Column:
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"))


class SpanModel:
    """The fitted trees as an expression, and the threshold of each kind (None: nothing is added)."""

    def __init__(self, trees: list[tuple[float, object]], thresholds: dict[str, float | None]):
        self.trees, self.thresholds = trees, thresholds

    def probability(self, values: dict[str, Column]) -> Column:
        def walk(node: object) -> Column:
            if node.subtreeDepth() == 0:
                return F.lit(node.prediction())
            split = node.split()
            return F.when(values[FEATURES[split.featureIndex()]] <= split.threshold(), walk(node.leftChild())).otherwise(walk(node.rightChild()))

        margin = F.lit(0.0)
        for weight, root in self.trees:
            margin = margin + F.lit(weight) * walk(root)
        return 1 / (1 + F.exp(-2 * margin))

    def added(self, kind: str, candidates: Column) -> Column:
        """Those of an array of candidates that are added: they pass the kind's check and reach its threshold."""
        least = self.thresholds.get(kind)
        if least is None or not self.trees:
            return F.filter(candidates, lambda _: F.lit(False))
        passed = F.filter(candidates, lambda x: ~_fails(kind, x))
        # features are computed once for a candidate, not once for each node of the trees
        weighed = F.transform(passed, lambda x: F.struct(x.alias("x"), F.struct(*[v.alias(n) for n, v in _features(kind, x).items()]).alias("f")))
        return F.transform(F.filter(weighed, lambda w: self.probability({n: w["f"][n] for n in FEATURES}) >= least), lambda w: w["x"])


def _fails(kind: str, x: Column) -> Column:
    """Whether a candidate fails its kind's check, whatever its format."""
    n, match = F.length(x["digits"]), x["match"]
    return {
        "email": ~match.rlike(r"(?:\.|dot[\])]\x20?)[A-Za-z]{2}"), "ip": ~F.regexp_replace(match, r"[\[\]]", "").rlike(rf"^{_PART}([.:]{_PART}){{3}}$") & ~match.rlike("^([0-9A-Fa-f]+:){7}"), "card": ~(n.between(13, 19) & _luhn(x["digits"])),
        "phone": ~n.between(9, 15), "secret": ~(match.rlike("[0-9]") & match.rlike("[A-Za-z]")),
    }[kind]


def _grouped(digits: Column, pattern: str, form: str) -> Column:
    """The digits in groups; empty if they don't fit."""
    return F.when(digits.rlike(f"^{pattern}$"), F.regexp_replace(digits, f"^{pattern}$", form)).otherwise("")


def _clothes(kind: str, x: Column) -> list[tuple[Column, Column, float]]:
    """(before, match, label) of what is made of a valid base span."""
    match, digits, before = x["match"], x["digits"], x["before"]
    if kind == "email":
        name, host = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
        return [
            (before, F.concat(name, F.lit(" [at] "), host), 1.0), (before, F.concat(name, F.lit("(at)"), F.regexp_replace(host, r"\.", " (dot) ")), 1.0), (before, F.concat(name, F.lit(" @ "), host), 1.0),
            (before, F.concat(F.right(digits, F.lit(3)), F.lit(" @ "), F.length(match).cast("string"), F.lit("."), F.left(F.regexp_replace(host, "[^a-z]", ""), F.lit(2))), 0.0),
        ]
    if kind == "ip":
        return [(before, F.regexp_replace(match, r"\.", "[.]"), 1.0), (before, F.regexp_replace(match, r"\.([0-9]+)$", "[.]$1"), 1.0), (before, F.regexp_replace(match, r"\.", ":"), 0.0), (before, F.regexp_replace(match, r"^([0-9]+)\.([0-9]+)\.", "$1:$2:"), 0.0)]
    if kind == "card":
        four, odd = "([0-9]{4})([0-9]{4})([0-9]{4})([0-9]+)", "([0-9]{2})([0-9]{3})([0-9]{3})([0-9]{3})([0-9]+)"
        return [(before, _grouped(digits, four, f"$1{sign}$2{sign}$3{sign}$4"), 1.0) for sign in "./"] + [(before, _grouped(digits, odd, f"$1{sign}$2{sign}$3{sign}$4{sign}$5"), 0.0) for sign in "./"]
    if kind == "secret":
        plain = F.translate(match, "0123456789", "abcdefghij")
        return [(F.concat(before, F.lit(told)), match, 1.0) for told in (" token=", ' key: "', " password ", ' secret = "')] + [(before, match, 0.0), (F.concat(before, F.lit(" id ")), match, 0.0), (F.concat(before, F.lit("/")), plain, 0.0)]
    local = F.right(digits, F.lit(10))  # without the country's number
    three = "([0-9]{3})([0-9]{3})([0-9]{4})"
    told = F.concat(before, F.lit("tel "))
    return [
        (before, _grouped(local, three, r"($1) $2-$3"), 1.0), (before, _grouped(local, three, "$1-$2-$3"), 1.0), (before, F.regexp_replace(match, r"^\+", ""), 1.0), (told, _grouped(local, three, "$1 $2 $3"), 1.0), (told, _grouped(local, three, "$1.$2.$3"), 1.0),
        (before, _grouped(local, three, "$1 $2 $3"), 0.0), (before, _grouped(local, "([0-9])([0-9]{3})([0-9]{3})([0-9]{3})", "$1 $2 $3 $4"), 0.0), (before, _grouped(local, "([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})", "$1-$2-$3 $4"), 0.0),
        (before, _grouped(local, three, "$1.$2.$3"), 0.0), (told, _grouped(local, "([0-9]{2})([0-9]{2})([0-9]{3}).*", "$1-$2-$3"), 0.0),
    ]


def _words_of(seed: Column) -> Column:
    """Some letters made from a seed."""
    return F.translate(F.left(F.md5(seed), F.lit(7)), "0123456789", "ghijklmnop")


def _made(kind: str, seed: Column) -> Column:
    """A valid span of the kind in the base format, made from a seed."""
    at = lambda i, n: F.pmod(F.xxhash64(seed, F.lit(i)), F.lit(n))
    number = lambda i, long: F.lpad(at(i, 10**long).cast("string"), long, "0")
    if kind == "email":
        ends = F.array(*[F.lit(x) for x in ("com", "org", "net", "de", "fr", "es", "io", "co.uk")])
        return F.concat(_words_of(F.concat(seed, F.lit("a"))), F.lit("."), at(1, 100).cast("string"), F.lit("@"), _words_of(F.concat(seed, F.lit("b"))), F.lit("."), F.element_at(ends, (at(2, 8) + 1).cast("int")))
    if kind == "ip":
        return F.concat_ws(".", *[at(i, 256).cast("string") for i in range(4)])
    if kind == "card":
        start = F.concat(number(1, 8), number(2, 7))
        ends = F.filter(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: _luhn(F.concat(start, d)))
        return F.concat(start, F.element_at(ends, 1))
    if kind == "phone":
        return F.concat(F.lit("+"), (at(1, 98) + 1).cast("string"), F.lit(" "), (at(2, 800) + 200).cast("string"), F.lit(" "), number(3, 3), F.lit("-"), number(4, 4))
    return F.when(at(1, 2) == 0, F.sha1(seed.cast("binary"))).otherwise(F.left(F.regexp_replace(F.base64(F.sha2(seed.cast("binary"), 256).cast("binary")), "=", ""), F.lit(40)))


def _by_kind(values: dict[str, Column]) -> Column:
    """The value of the row's kind (column ``name``)."""
    out = None
    for kind, value in values.items():
        out = F.when(F.col("name") == kind, value) if out is None else out.when(F.col("name") == kind, value)
    return out


def training_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Labelled candidates that pass their checks, of a sample of documents: name (kind), label, place (a hash of where it comes from), the features.

    Keys have no base spans: of the sample's own, one behind a word that announces it is positive, others are negative.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).repartition(cores)
    sample = materialize(find_candidates(given, "text").select("id", "text", *[f"base_{k}" for k in KINDS], "wide_secret"))
    real = sample.select("id", F.explode(F.concat(*[F.transform(f"base_{k}", partial_of(_known, k)) for k in KINDS])).alias("b")).select(F.xxhash64("id", "b.x.start").alias("place"), "b.name", "b.x")
    # made spans stand where the sample's texts have none to offer
    rows = sample.count()
    hosts = sample.select("id", "text", F.xxhash64("id", F.lit("made")).alias("_order")).orderBy("_order", "id").limit(MADE_SPANS).select("id", "text", F.explode(F.sequence(F.lit(1), F.lit(-(-MADE_SPANS // max(1, min(rows, MADE_SPANS)))))).alias("turn"))
    seed = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("turn").cast("string"), F.lit(":"), F.col("name"))
    made = hosts.select("*", F.explode(F.array(*[F.lit(k) for k in ADDED])).alias("name")).withColumn("seed", seed)
    made = made.withColumn("from", (F.pmod(F.xxhash64("seed"), F.greatest(F.length("text") - 40, F.lit(1))) + 1).cast("int")).withColumn("match", _by_kind({k: _made(k, F.col("seed")) for k in ADDED}))
    context = F.concat(F.regexp_replace(F.substr("text", F.col("from"), F.lit(22)), r"[0-9@]", ""), F.lit(" ")), F.concat(F.lit(" "), F.regexp_replace(F.substr("text", F.col("from") + 22, F.lit(11)), r"[0-9@]", ""))
    x = F.struct(F.col("match"), F.regexp_replace("match", "[^0-9]", "").alias("digits"), context[0].alias("before"), context[1].alias("after"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))
    bases = real.unionByName(made.select(F.xxhash64("seed", F.lit("made")).alias("place"), "name", x.alias("x")))
    clothes = _by_kind({k: F.array(*[F.struct(b.alias("b"), m.alias("m"), F.lit(label).alias("label")) for b, m, label in _clothes(k, F.col("x"))]) for k in ADDED})
    dressed = bases.select("place", "name", "x", F.explode(clothes).alias("as")).where("as.m <> ''")
    dressed = dressed.select("place", "name", F.col("as.label").alias("label"), F.length("as.b").alias("from"), F.length("as.m").alias("long"), F.concat("as.b", "as.m", "x.after").alias("text"))
    again = find_candidates(dressed.repartition(cores), "text").select("place", "name", "label", F.explode(_by_kind({k: F.filter(f"wide_{k}", lambda w: (w["start"] < F.col("from") + F.col("long")) & (w["end"] > F.col("from"))) for k in ADDED})).alias("x"))
    keys = sample.select("id", F.explode("wide_secret").alias("x")).select(F.xxhash64("id", "x.start").alias("place"), F.lit("secret").alias("name"), F.lower("x.before").rlike(CUES["secret"]).cast("double").alias("label"), "x")
    passed = again.unionByName(keys).where(~_by_kind({k: _fails(k, F.col("x")) for k in ADDED}))
    features = {k: _features(k, F.col("x")) for k in ADDED}
    return passed.select("name", "label", "place", *[_by_kind({k: features[k][n] for k in ADDED}).alias(n) for n in FEATURES])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SpanModel:
    """Trees and thresholds from about ``SAMPLE_DOCUMENTS`` documents chosen by hash, and at most ``SAMPLE_CANDIDATES`` of their spans.

    An empty table gives a model that adds nothing. A kind whose held-out spans don't reach the precision gets no
    threshold, nothing of it is added, and a warning names it.
    """
    rows = docs.select(id_col).count()
    if not rows:
        return SpanModel([], {})
    place = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit("fit")), 11) * F.lit(2.0**-53)
    labelled = training_spans(docs.where(place <= min(1.0, SAMPLE_DOCUMENTS / rows)), id_col, text_col)
    labelled = materialize(labelled.orderBy("place", "name", "label", *FEATURES).limit(SAMPLE_CANDIDATES))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labelled)
    train, held = vectors.where("place % 3 <> 0"), labelled.where("place % 3 = 0")
    if train.agg(F.countDistinct("label")).first()[0] < 2:
        warnings.warn("no spans of both classes to learn from: nothing is added", stacklevel=2)
        return SpanModel([], {})
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(train)
    java = fitted._java_obj
    trees = [(float(w), tree.rootNode()) for w, tree in zip(java.treeWeights(), java.trees(), strict=True)]
    model = SpanModel(trees, {})
    scored = held.withColumn("bin", F.floor(model.probability({f: F.col(f) for f in FEATURES}) * 20))
    bins = {(r["name"], r["bin"]): (r["good"], r["n"]) for r in scored.groupBy("name", "bin").agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()}
    for kind in ADDED:
        n, best = 0, None
        for at in range(20, -1, -1):
            good, here = bins.get((kind, at), (0, 0))
            if here and good / here < PRECISION:  # the bin's own precision, not that of all above it
                break
            n += here
            if here and n >= LEAST_SUPPORT:
                best = at / 20
        model.thresholds[kind] = best
    missing = [k for k in ADDED if model.thresholds[k] is None]
    if missing:
        warnings.warn(f"no threshold reaches the precision: nothing is added of {', '.join(missing)}", stacklevel=2)
    return model


def _digest(arrays: dict[str, Column]) -> Column:
    """kind:start:end of all spans, by kind, then start, joined by commas."""
    parts = [F.transform(F.sort_array(F.transform(a, lambda x: F.struct(x["start"], x["end"]))), partial_of(_place, k)) for k, a in arrays.items()]
    return F.array_join(F.concat(*parts), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """``docs`` with base_<kind> and added_<kind>: arrays of spans (match, digits, before, after, start, end).

    Places are code points, ends exclusive. Null and empty texts have no spans; very long ones are searched whole. Added
    spans lie in what the base spans leave of the text. An empty table gives an empty result. Rows are independent, so repeated rows get equal results. Columns of those names are replaced.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if docs.select(F.spark_partition_id().alias("at")).distinct().count() < cores:  # a scan of few row groups
        docs = docs.repartition(cores)
    model = model or fit(docs, id_col, text_col)
    names = [f"base_{k}" for k in KINDS] + [f"added_{k}" for k in ADDED]
    packed = docs.select(F.struct(*[c for c in docs.columns if c not in names]).alias("_doc"), F.col(text_col).alias("_text"))
    found = find_candidates(packed, "_text")
    found = found.withColumns({f"added_{k}": model.added(k, F.col(f"wide_{k}")) for k in ADDED})
    return found.select("_doc.*", *names)


def _every() -> dict[str, Column]:
    """All spans by kind, of ``find_personal_data``."""
    return {k: F.concat(f"base_{k}", f"added_{k}") if k in KINDS else F.col(f"added_{k}") for k in ADDED}


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The spans of ``find_personal_data``: counts of base spans, the digest of their places, all places, numbers of added ones and of all."""
    base, every = {k: F.col(f"base_{k}") for k in KINDS}, _every()
    added = sum((F.size(f"added_{k}") for k in ADDED), F.lit(0)).cast("long")
    return found.select(
        id_col, *[F.size(base[k]).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_digest(base).cast("binary"), 256).alias("base_sha256"), _digest(every).alias("spans"),
        added.alias("n_added"), sum((F.size(x) for x in every.values()), F.lit(0)).cast("long").alias("n_found"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """``docs`` with the text's spans replaced by [kind]; columns are those of ``docs``. Overlapping spans become one, named by the first."""
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = find_personal_data(packed, "_id", "_text", model)
    spans = F.sort_array(F.concat(*[F.transform(x, partial_of(_named, k)) for k, x in _every().items()]))
    text = F.col("_text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        skip = x["start"] < acc["at"]
        between = F.substr(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        out = F.when(skip, acc["out"]).otherwise(F.concat(acc["out"], between, F.lit("["), x["kind"], F.lit("]")))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    done = found.withColumn("_spans", spans).withColumn("_done", F.aggregate("_spans", start, step))
    new = F.when(F.size("_spans") == 0, text).otherwise(F.concat("_done.out", F.substr(text, (F.col("_done.at") + 1).cast("int"), F.length(text))))
    return done.select(*[new.alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in docs.columns])
