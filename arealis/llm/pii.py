"""Personal data: loose candidate spans, boosted trees, calibrated thresholds.

Only DataFrame functions and the JVM's boosted trees run here. Four base patterns give
spans that always count. Looser generators propose overlapping spans, also where a base
match swallowed two things and failed. Boosted trees learn from the base matches (passed:
personal data; failed: not) by format and context, and are then written out as a column
expression, so scoring stays inside the row. Each kind's threshold is the smallest that
kept the wanted precision on documents the trees have not seen.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealis.llm.store import kept

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the contract's patterns; they match the same and never backtrack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser generators, by kind.
LOOSE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"),
    ("phone", r"(?<![0-9+(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
)
#: Characters before a span that count as its context.
CONTEXT = 12
#: Trees, their depth; wanted precision.
TREES, DEPTH, PRECISION = 20, 3, 0.995
#: Bins of a feature at least: more than any feature has values, so each has its own.
BINS = 128
STEPS = tuple(x / 100 for x in range(50, 100, 5))
#: Code points of the blocks from which a redacted text is put together.
WIDTH = 4096


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The state after each item, from ``step(state, item)``.

    An append copies what it appends to, so items go in blocks of about the root of their
    number: n items cost n times its root, not its square.
    """

    def blocks(own: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(own))).cast("int"), F.lit(1))
        last = F.greatest(F.ceil(F.size(own) / width).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(own, b * width + 1, width))

    # each block's states begin with the last of the block before
    block = lambda state, own: F.aggregate(own, F.array(state), lambda out, x: F.concat(out, F.array(step(F.element_at(out, -1), x))))
    all_ = F.aggregate(_bound(items, blocks), F.array(F.array(zero)), lambda out, own: F.concat(out, F.array(block(F.element_at(F.element_at(out, -1), -1), own))))
    return F.flatten(F.transform(all_, lambda own: F.slice(own, 2, F.size(own))))


def _backwards(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The same from the last item to the first, in the items' order."""
    return F.reverse(_running(F.reverse(items), zero, step))


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that don't overlap: start and end in code points, match, text before.

    Each piece runs from the last match's end to this one's, so lengths add up to places.
    """
    pieces = F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?)(?:{pattern})"), F.lit(0))
    cut = F.transform(
        pieces,
        lambda p: F.struct(
            F.length(p).alias("n"),
            F.regexp_extract(p, f"(?:{pattern})$", 0).alias("m"),
            p.alias("p"),
        ),
    )
    place = lambda x, end: F.struct(
        (end - F.length(x["m"])).alias("s"),
        end.alias("e"),
        x["m"].alias("m"),
        F.right(F.left(x["p"], x["n"] - F.length(x["m"])), F.lit(CONTEXT)).alias("c"),
    )
    return _bound(cut, lambda own: F.zip_with(own, _running(own, F.lit(0), lambda at, x: at + x["n"]), place))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check sum of card numbers; callers bound the length."""
    twice = lambda i: F.substring(digits, -i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + F.when(twice(i) > 9, twice(i) - 9).otherwise(twice(i)))
    return total % 10 == 0


def _is_card(m: Column) -> Column:
    d = _digits(m)
    return F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False)


def _is_ip(m: Column) -> Column:
    part = lambda x: F.ltrim(x, F.lit("0"))
    return F.forall(
        F.split(m, r"\."),
        lambda x: F.when(F.length(part(x)) <= 3, F.coalesce(part(x).try_cast("int"), F.lit(0)) <= 255).otherwise(False),
    )


VALID = {
    "email": lambda m: F.lit(True),
    "ip": _is_ip,
    "card": _is_card,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _may_have(kind: str, text: Column, loose: bool = False) -> Column:
    if kind == "email":
        return text.rlike(r"[(\[]at[)\]]") if loose else text.contains("@")
    return F.col("__digits") & text.contains("+") if kind == "phone" and not loose else F.col("__digits")


def _with_matches(docs: DataFrame) -> DataFrame:
    """Adds the raw base matches (__b_kind) and the loose ones (__l) to each row."""
    text = F.col("__text")
    none = F.array().cast("array<struct<s:int,e:int,m:string,c:string>>")
    out = docs.withColumn("__text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = out.withColumn("__digits", text.rlike("[0-9]"))
    base = {f"__b_{k}": F.when(_may_have(k, text), _matches(text, p)).otherwise(none) for k, p in BASE.items()}
    loose = {f"__l_{i}": F.when(_may_have(k, text, True), _matches(text, p)).otherwise(none) for i, (k, p) in enumerate(LOOSE)}
    return out.withColumns(base | loose)


def _features(kind: Column, x: Column) -> Column:
    """Format and context of a candidate as an array of numbers."""
    m, c, d = x["m"], x["c"], _digits(x["m"])
    n = F.length(d)
    flag = lambda b: b.cast("double")
    return F.array(
        kind.cast("double"),
        F.least(F.length(m), F.lit(100)).cast("double"),
        F.least(n, F.lit(40)).cast("double"),
        F.least(F.size(F.split(m, "[^0-9A-Za-z]+")), F.lit(20)).cast("double"),
        flag(F.when(n.between(13, 19), _luhn(d)).otherwise(False)),
        flag(m.rlike(r"^[0-9.]+$") & F.when(m.rlike(r"^[0-9]+(\.[0-9]+){3}$"), _is_ip(m)).otherwise(False)),
        flag(m.startswith("+")),
        flag(m.contains("(")),
        F.size(F.array_distinct(F.split(F.left(d, F.lit(40)), ""))).cast("double"),
        flag(m.rlike(r"(@|[(\[]at[)\]])")),
        flag(c.rlike(r"(^|[\s(\[:;,=\"'])$")),
        F.length(F.regexp_replace(c, r"[^\p{L}]", "")).cast("double"),
        flag(c.rlike(r"[0-9]$")),
    )


def _judged(i: int, k: str) -> Column:
    """The base matches of a kind as candidates that passed or failed."""
    return F.transform(
        F.col(f"__b_{k}"),
        lambda x: F.struct(
            F.lit(i).alias("kind"),
            x["s"].alias("s"),
            x["e"].alias("e"),
            _features(F.lit(i), x).alias("f"),
            VALID[k](x["m"]).cast("int").alias("label"),
        ),
    )


def _open(j: int, k: str) -> Column:
    """The loose matches of a generator that no base match equals, as open candidates."""
    i = KINDS.index(k)
    tagged = lambda name, tag: F.transform(F.col(name), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(tag).alias("tag"), x["m"].alias("m"), x["c"].alias("c")))
    # an equal base match stands just before
    twin = lambda own, x, at: F.coalesce((F.get(own, at - 1)["s"] == x["s"]) & (F.get(own, at - 1)["e"] == x["e"]), F.lit(False))
    fresh = _bound(
        F.array_sort(F.concat(tagged(f"__b_{k}", 0), tagged(f"__l_{j}", 1))),
        lambda own: F.filter(own, lambda x, at: (x["tag"] == 1) & ~twin(own, x, at)),
    )
    return F.transform(
        fresh,
        lambda x: F.struct(
            F.lit(i).alias("kind"),
            x["s"].alias("s"),
            x["e"].alias("e"),
            _features(F.lit(i), x).alias("f"),
            F.lit(None).cast("int").alias("label"),
        ),
    )


def _passed(i: int, k: str) -> Column:
    ok = F.filter(F.col(f"__b_{k}"), lambda x: VALID[k](x["m"]))
    return F.transform(ok, lambda x: F.struct(F.lit(i).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


@dataclass
class Model:
    """Trees as nested tuples with their weights, and a threshold for each kind."""

    trees: list[tuple[float, object]]
    thresholds: dict[str, float]

    def score(self, f: Column) -> Column:
        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            at, threshold, left, right = node
            return F.when(f[at] <= threshold, walk(left)).otherwise(walk(right))

        margin = F.lit(0.0)
        for weight, tree in self.trees:
            margin = margin + F.lit(weight) * walk(tree)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))


def _tree(node):
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def fit(docs: DataFrame, precision: float = PRECISION) -> Model | None:
    """Trees and thresholds from all base matches in ``docs``; None if one class is missing.

    Matches of equal features are one row with their number as its weight, so learning takes
    as long as there are different matches. A fifth of the documents, by hash of the text, only sets the
    thresholds; a kind without passed matches there gets none, so nothing is added for it.
    """
    judged = F.concat(*[_judged(i, k) for i, k in enumerate(KINDS)])
    of = F.xxhash64("__text")
    aside = F.pmod(F.xxhash64(of), F.lit(5)) == 0
    rows = _with_matches(docs.select("text")).select(aside.alias("aside"), F.explode(judged).alias("x"))
    rows = kept(rows.groupBy("aside", "x.kind", "x.f", "x.label").agg(F.count(F.lit(1)).alias("n")), "candidates")
    learn = rows.where("NOT aside")
    different, classes = learn.agg(F.count(F.lit(1)), F.count_distinct("label")).first()
    if classes < 2:
        return None
    # up to the square of its bins MLlib looks at all rows for the places of splits, beyond it draws some
    bins = max(BINS, math.isqrt(different) + 1)
    boost = GBTClassifier(featuresCol="v", labelCol="y", weightCol="w", maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=bins)
    fitted = boost.fit(learn.select(array_to_vector("f").alias("v"), F.col("label").cast("double").alias("y"), F.col("n").cast("double").alias("w")))
    java = fitted._java_obj
    trees = [(float(w), _tree(t.rootNode())) for w, t in zip(java.treeWeights(), java.trees(), strict=True)]
    model = Model(trees, {})
    seen = rows.where("aside").select("kind", "label", "n", model.score(F.col("f")).alias("p"))
    counts = [F.sum(F.when(F.col("p") >= t, F.col("n")).otherwise(0)).alias(f"n{i}") for i, t in enumerate(STEPS)]
    hits = [F.sum(F.when((F.col("p") >= t) & (F.col("label") == 1), F.col("n")).otherwise(0)).alias(f"h{i}") for i, t in enumerate(STEPS)]
    for r in seen.groupBy("kind").agg(*counts, *hits).collect():
        good = [t for i, t in enumerate(STEPS) if r[f"h{i}"] and r[f"h{i}"] >= precision * r[f"n{i}"]]
        if good:
            model.thresholds[KINDS[r["kind"]]] = good[0]
    return model


def find(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows with __base and __added: spans of kind (0 ..), s and e in code points, in order.

    An added span passes its kind's threshold, touches no base span, and is the best (by
    score, then length, then place) of a run of such spans that overlap one after the other.
    """
    out = _with_matches(docs)
    base = F.concat(*[_passed(i, k) for i, k in enumerate(KINDS)])
    out = out.withColumn("__base", base)
    none = F.array().cast("array<struct<kind:int,s:int,e:int>>")
    if model is None or not model.thresholds:
        return out.withColumn("__added", none)
    scored = F.transform(
        _apart(F.col("__base"), F.concat(*[_open(j, k) for j, (k, _) in enumerate(LOOSE)])),
        lambda x: F.struct(
            x["s"].alias("s"),
            x["e"].alias("e"),
            F.struct(model.score(x["f"]).alias("p"), (x["e"] - x["s"]).alias("n"), (-x["s"]).alias("o"), (-x["kind"]).alias("k")).alias("rank"),
            x["kind"].alias("kind"),
        ),
    )
    limit = F.create_map(*[F.lit(x) for k, t in model.thresholds.items() for x in (KINDS.index(k), t)])
    out = out.withColumn("__open", F.when(F.col("__digits") | F.col("__text").contains("at"), scored))
    out = out.withColumn("__open", F.array_sort(F.filter("__open", lambda x: F.coalesce(x["rank"]["p"] >= limit[x["kind"]], F.lit(False)))))
    added = F.array_sort(F.array_distinct(F.transform(_best_of_runs(F.col("__open")), lambda x: F.struct(x["kind"], x["s"], x["e"]))))
    return out.withColumn("__added", F.coalesce(added, none))


def _apart(base: Column, candidates: Column) -> Column:
    """The candidates that overlap no base span, by place.

    In the order of starts, the greatest end of the base spans before a candidate and the
    start of the next one after it tell.
    """
    spans_ = F.transform(base, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(0).alias("tag"), x["kind"].alias("kind"), F.array().cast("array<double>").alias("f")))
    open_ = F.transform(candidates, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(1).alias("tag"), x["kind"].alias("kind"), x["f"].alias("f")))
    far = F.lit(2**31 - 1)

    def picked(own: Column) -> Column:
        before = _running(own, F.lit(0), lambda end, x: F.when(x["tag"] == 0, F.greatest(end, x["e"])).otherwise(end))
        after = _backwards(own, far, lambda start, x: F.when(x["tag"] == 0, x["s"]).otherwise(start))
        free = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
        both = F.zip_with(own, free, lambda x, y: F.struct(x.alias("x"), ((x["tag"] == 1) & (y["b"] <= x["s"]) & (y["a"] >= x["e"])).alias("ok")))
        return F.transform(F.filter(both, lambda z: z["ok"]), lambda z: z["x"])

    return _bound(F.array_sort(F.concat(spans_, open_)), picked)


def _best_of_runs(spans_: Column) -> Column:
    """Of each run of overlapping spans (sorted, with a rank) the one of highest rank."""

    def picked(own: Column) -> Column:
        start = F.struct(F.lit(-1).alias("end"), F.lit(True).alias("new"))
        step = lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (x["s"] >= a["end"]).alias("new"))
        return _bound(F.zip_with(own, _running(own, start, step), lambda x, a: F.struct(x.alias("x"), a["new"].alias("new"))), tops)

    def tops(own: Column) -> Column:
        rank = F.get(own, F.lit(0))["x"]["rank"]
        zero = F.struct(F.lit(True).alias("reset"), rank.alias("best"))
        ahead = _running(own, zero, lambda a, z: F.struct(F.lit(False).alias("reset"), F.when(z["new"], z["x"]["rank"]).otherwise(F.greatest(a["best"], z["x"]["rank"])).alias("best")))
        # from the end: a run is left behind with its first span
        back = _backwards(own, zero, lambda a, z: F.struct(z["new"].alias("reset"), F.when(a["reset"], z["x"]["rank"]).otherwise(F.greatest(a["best"], z["x"]["rank"])).alias("best")))
        most = F.zip_with(ahead, back, lambda a, b: F.greatest(a["best"], b["best"]))
        both = F.zip_with(own, most, lambda z, m: F.struct(z["x"].alias("x"), (z["x"]["rank"] >= m).alias("ok")))
        return F.transform(F.filter(both, lambda z: z["ok"]), lambda z: z["x"])

    return F.when(F.size(spans_) > 0, _bound(spans_, picked)).otherwise(F.slice(spans_, 1, 0))


def _shown(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", name[x["kind"]], x["s"].cast("string"), x["e"].cast("string"))))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added.

    Null texts count as empty and have no spans; repeated rows are each judged; without
    both passed and failed base matches nothing can be learned and only base spans remain.
    An empty table gives an empty result. Other columns are ignored.
    """
    own = docs.select("doc_id", "text")
    found = find(own, fit(own))
    count = lambda i: F.size(F.filter("__base", lambda x: x["kind"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_shown(F.col("__base")), 256).alias("base_sha256"),
        _shown(F.array_sort(F.concat("__base", "__added"))).alias("spans"),
        F.size("__added").cast("long").alias("n_added"),
    )


def _part(blocks: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` to ``end`` of a text in blocks; touches those blocks only."""
    first, last = F.floor(start / WIDTH).cast("int"), F.floor(end / WIDTH).cast("int")
    of = lambda b, a, n: F.substring(F.coalesce(F.get(blocks, b), F.lit("")), a, n)
    inside = of(first, start % WIDTH + 1, end - start)
    middle = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(first == last, inside).otherwise(F.concat(of(first, start % WIDTH + 1, F.lit(WIDTH)), middle, of(last, F.lit(1), end % WIDTH)))


def _replaced(spans_: Column, blocks: Column) -> Column:
    """The text with each run of overlapping spans replaced by the kind of its first."""
    name = F.array(*[F.lit(k.upper()) for k in KINDS])
    ends = _running(spans_, F.lit(0), lambda end, x: F.greatest(end, x["e"]))

    def put(end: Column) -> Column:
        before = F.transform(end, lambda e, i: F.coalesce(F.get(end, i - 1), F.lit(0)))
        both = F.filter(F.zip_with(spans_, before, lambda x, b: F.struct(x.alias("x"), b.alias("b"))), lambda z: z["x"]["s"] >= z["b"])
        parts = F.transform(both, lambda z: F.concat(_part(blocks, z["b"], z["x"]["s"]), F.lit("["), name[z["x"]["kind"]], F.lit("]")))
        last = F.coalesce(F.get(end, F.size(end) - 1), F.lit(0))
        return F.concat(F.array_join(parts, ""), _part(blocks, last, F.length("__text")))

    return _bound(ends, put)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with each span of the text replaced by its kind in brackets.

    Overlapping spans become one, named by the first. ``n_chars`` follows the text where
    the column exists. Texts without spans, also null ones, stay as they are.
    """
    names = docs.columns
    hidden = docs.withColumnsRenamed({c: f"__c{i}" for i, c in enumerate(names)})
    text = f"__c{names.index('text')}"
    found = find(hidden.withColumn("text", F.col(text)), fit(docs))
    ordered = F.array_sort(F.transform(F.concat("__base", "__added"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    joined = _bound(ordered, lambda own: _bound(F.regexp_extract_all(F.col("__text"), F.lit(f"(?s).{{1,{WIDTH}}}"), F.lit(0)), lambda text: _replaced(own, text)))
    new = F.when(F.size(F.concat("__base", "__added")) > 0, joined).otherwise(F.col(text))
    out = found.withColumn(text, new)
    if "n_chars" in names:
        at = f"__c{names.index('n_chars')}"
        changed = F.size(F.concat("__base", "__added")) > 0
        out = out.withColumn(at, F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(at)))
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)])
