"""Personal data in texts, with DataFrame functions only.

Fixed formats (email, ip, card, phone) are always found. Beyond them generators of high recall
propose spans that may overlap: written-out email addresses, phone numbers without a plus
sign, six-group addresses, card-like numbers that fail their checksum, and tokens of 20 characters or more.
Boosted trees judge format and context of each proposal, their probability is calibrated, and a threshold per kind
selects. Of selected proposals that overlap, the likeliest stays; what overlaps a fixed
format is dropped.

Offsets count code points, ends are exclusive. Null and empty texts have no spans; repeated
rows repeat; an empty table gives an empty one; other columns are ignored. Patterns use
possessive repeats, and what is worked out along a text is gathered in blocks of ``BLOCK`` spans,
so texts of many spans take time in proportion to their length.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm.boosting import BoostedTrees
from vicinal.llm.common import rows_of

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
#: Least precision on rows kept for the thresholds that a kind's threshold has to give.
LEAST_PRECISION = 0.97
CONTEXT, JUDGED = 40, 128
#: Spans that are gathered in one array at a time, and code points of the parts that a text is cut into for redaction.
BLOCK, PART = 128, 2048

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# The fixed formats. A local part is tried where its run begins or a match has just ended, a
# number where its run begins: other starts in a run lead to the same failure.
_BASE = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
# Generators: kind, pattern, and what a text must hold for the pattern to be tried.
_PROPOSED = (
    (
        "email",
        rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}(?:\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20){_LABEL}{{1,63}}"
        rf"(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20|\.){_LABEL}{{2,24}}){{1,3}}+",
        r"(?:[\[(\x20]at[\])\x20])",
    ),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", r"(?:[0-9A-Fa-f]{1,4}:){7}"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,7}(?![0-9])", r"[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}"),
    ("phone", r"(?<![0-9+.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])", r"[0-9][\x20)][\x20]?[0-9]{3,4}[\x20.-][0-9]|[0-9][.-][0-9]{3,4}[.\x20-][0-9]"),
    ("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+", r"[A-Za-z0-9_-]{20}"),
)
# Words before a span that speak for or against a kind.
_CUES = {
    "email": "mail|contact|write|reach|address",
    "phone": "tel|phone|call|fax|mobile|cell|sms",
    "card": "card|visa|master|credit|debit|payment|cvv",
    "secret": "token|secret|key|password|passwd|api|auth|bearer",
    "ip": "ip|host|server|login|client",
    "other": "order|invoice|isbn|version|serial|article|ref|page|room|year|build|sum|total|commit",
}
FEATURES = 11 + len(_CUES) + len(KINDS)
_SPANS = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scan(items: Column, first: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """``state, out``: the last state, and what the steps gave for each item, in arrays of ``BLOCK`` of type ``kind``.

    A step takes the state and an item and gives the next state and a result. One array that grew by
    an element a step would be copied at every step.
    """

    def one(acc: Column, item: Column) -> Column:
        state, out = step(acc["state"], item)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

    def over(held: Column) -> Column:
        none = F.struct(first.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))

        def block(acc: Column, i: Column) -> Column:
            begin = F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
            places = F.sequence(i * BLOCK, F.least(i * BLOCK + BLOCK, F.size(held)) - 1)  # a slice would copy the whole array first
            joined = lambda m: F.struct(m["state"].alias("state"), F.concat(acc["out"], F.array(m["out"])).alias("out"))
            return F.aggregate(places, begin, lambda inner, k: one(inner, F.get(held, k)), joined)

        blocks = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / BLOCK).cast("int"))
        return F.when(F.size(held) > 0, F.aggregate(blocks, none, block)).otherwise(none)

    return _once(items, over)


def _marked(text: Column, pattern: str, needs: str) -> Column:
    """Matches with their places: the text is split around marked matches, lengths are summed up."""
    clean = F.translate(text, "\x01\x02", "\x03\x03")
    pieces = F.split(F.regexp_replace(clean, pattern, "\x01$0\x02"), "[\x01\x02]")

    def places(p: Column) -> Column:
        starts = F.flatten(_scan(p, F.lit(0), lambda at, x: (at + F.length(x), at), "int")["out"])
        return _once(
            F.struct(p.alias("p"), starts.alias("s")),
            lambda both: F.transform(
                F.sequence(F.lit(1), F.size(both["p"]) - 2, F.lit(2)),
                lambda i: F.struct(
                    F.get(both["s"], i).alias("start"),
                    F.get(both["s"], i + 1).alias("end"),
                    F.get(both["p"], i).alias("value"),
                    F.substring(F.get(both["p"], i - 1), -CONTEXT, CONTEXT).alias("before"),
                    F.substring(F.get(both["p"], i + 1), 1, 1).alias("after"),
                ),
            ),
        )

    none = F.array().cast(_SPANS)
    found = _once(pieces, lambda p: F.when(F.size(p) > 2, places(p)).otherwise(none))
    holds = F.contains(text, F.lit(needs)) if needs == "@" else F.rlike(text, F.lit(needs))
    return F.when(holds, found).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""

    def worth(i: Column) -> Column:
        d = F.ascii(F.substring(digits, -i, F.lit(1))) - 48
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return F.rlike(value, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    n = F.length(_digits(value))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _passes(kind: str):
    return lambda c: _valid(kind, c["value"])


def _features(c: Column, kind: str) -> list[Column]:
    value, before = c["value"], F.lower(c["before"])
    n, digits = F.length(value), F.length(_digits(value))
    count = lambda keep: F.length(F.regexp_replace(value, f"[^{keep}]", ""))
    # A token of any length is judged as one of JUDGED characters with the same shares.
    scale = F.least(F.lit(1.0), F.lit(float(JUDGED)) / n) if kind == "secret" else F.lit(1.0)
    return [
        n * scale,
        digits * scale,
        digits / n,
        count("A-Z") * scale,
        (count("0-9A-Fa-f") / n),
        count(r"\x20.()-") * scale,
        F.size(F.array_distinct(F.split(value, "(?!^)"))) / F.least(n, F.lit(36)),
        F.rlike(value, F.lit(r"[0-9][A-Za-z]|[A-Za-z][0-9]")).cast("double"),
        *[F.rlike(before, F.lit(rf"(?<![a-z])(?:{words})[a-z]*[^a-z]*(?:is|no|nr|number|at|me)?[^a-z]*$")).cast("double") for words in _CUES.values()],
        F.rlike(before, F.lit("[=:\"'#(]\\s*$")).cast("double"),
        F.rlike(c["after"], F.lit("[\"')\\s.,;]|^$")).cast("double"),
        _luhn(_digits(value)).cast("double") if kind == "card" else F.lit(0.0),
        *[F.lit(1.0 if kind == k else 0.0) for k in KINDS],
    ]


def _proposals(text: Column) -> list[tuple[str, Column]]:
    return [(kind, _marked(text, pattern, needs)) for kind, pattern, needs in _PROPOSED]


# -- learning ---------------------------------------------------------------------------------
def _made(seed: int = 11, each: int = 240) -> list[tuple[str, str, int]]:
    """Texts with one proposal each that is personal data or is not: kind, text, label."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ba", "re", "ti", "on", "en", "lo", "ma", "sch", "de", "ción", "é", "st")) for _ in range(rng.randint(1, 4)))
    some = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(n))
    cue = lambda kind: rng.choice(_CUES[kind].split("|"))
    latin = lambda: "".join(rng.choice(("ba", "re", "ti", "on", "en", "lo", "ma", "sch", "de", "st")) for _ in range(rng.randint(2, 4)))
    out = []

    def put(kind, label, value, before=""):
        out.append((kind, f"{some(2, 8)} {before}{value} {some(1, 5)}", label))

    for _ in range(each):
        at, dot = rng.choice(((" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), (" (at) ", ".")))
        put("email", 1, f"{latin()}{rng.choice(('', '.', '_'))}{latin()}{at}{latin()}{dot}{rng.choice(('com', 'org', 'net', 'de'))}", rng.choice(("", cue("email") + " ", cue("email") + ": ")))
        put("email", 0, f"{latin()} at {latin()}.{latin()}" if rng.random() < 0.7 else f"{latin()} at {digit(2)}.{digit(2)}")
        put("ip", 1, ":".join(hexed(rng.randint(1, 4)) for _ in range(8)), rng.choice(("", cue("ip") + " ")))
        put("ip", 0, ":".join(digit(2) for _ in range(8)), rng.choice(("", cue("other") + " ")))
        sep = rng.choice(("", " ", "-"))
        put("card", 1, sep.join(digit(4) for _ in range(4)), cue("card") + rng.choice((" ", ": ", " no ", " number ")))
        put("card", 0, sep.join(digit(4) for _ in range(rng.choice((3, 4)))) + digit(1), rng.choice(("", cue("other") + " ", cue("other") + ": ", some(1, 2) + " ")))
        phone = rng.choice((f"({digit(3)}) {digit(3)}-{digit(4)}", f"{digit(3)}-{digit(3)}-{digit(4)}", f"{digit(3)}.{digit(3)}.{digit(4)}", f"{digit(3)} {digit(3)} {digit(4)}"))
        put("phone", 1, phone, rng.choice((cue("phone") + " ", cue("phone") + ": ")) if phone[0] != "(" else rng.choice(("", cue("phone") + " ")))
        put("phone", 0, rng.choice((f"{digit(2)} {digit(3)} {digit(3)}", f"{digit(4)}-{digit(3)}-{digit(3)}", f"{digit(3)} {digit(3)} {digit(4)}", f"{digit(2)}.{digit(3)}.{digit(3)}")), rng.choice(("", cue("other") + " ", some(1, 2) + " ")))
        put("secret", 1, rng.choice((hexed(rng.choice((32, 40, 64))), mixed(rng.randint(20, 48)))), rng.choice((f'{cue("secret")} = "', f"{cue('secret')}: ", f"{cue('secret')}=", "")))
        put("secret", 0, rng.choice(("".join(latin() for _ in range(6)), "-".join(latin() for _ in range(6)), digit(rng.randint(20, 30)), "_" * 24, "-" * 30, "x" * 25)), rng.choice(("", cue("other") + " ")))
    for _ in range(each // 4):  # longer tokens: keys, parts of signed tokens
        n = rng.randint(65, 400)
        put("secret", 1, rng.choice((hexed, mixed))(n), rng.choice((f'{cue("secret")} = "', f"{cue('secret')}: ", f"{cue('secret')}=", "")))
        put("secret", 0, rng.choice(("".join(latin() for _ in range(n // 6)), "-".join(latin() for _ in range(n // 6)), digit(n), "_" * n, "-" * n, "x" * n)), rng.choice(("", cue("other") + " ")))
    return out


_models: dict[str, tuple[BoostedTrees, dict[str, float]]] = {}


def model(spark: SparkSession) -> tuple[BoostedTrees, dict[str, float]]:
    """Trees and the threshold of each kind, learned once per session from made-up texts."""
    key = spark.sparkContext.applicationId
    if key not in _models:
        made = spark.createDataFrame(_made(), "kind string, text string, label int")
        rows = []
        for kind, found in _proposals(F.col("text")):
            best = F.array_sort(found, lambda a, b: F.length(b["value"]) - F.length(a["value"]))
            chosen = made.filter(F.col("kind") == kind).select("kind", "label", F.get(best, 0).alias("c")).filter("c is not null")
            rows += [(kind, r[0], r[1]) for r in chosen.select("label", F.array(*_features(F.col("c"), kind))).collect()]
        order = np.random.default_rng(5).permutation(len(rows))
        x, y = np.array([rows[i][2] for i in order]), np.array([rows[i][1] for i in order], dtype=float)
        kinds = np.array([rows[i][0] for i in order])
        held = np.arange(len(x)) % 4 == 3  # neither the trees nor their calibration see the rows that set the thresholds
        trees = BoostedTrees.fit(x[~held], y[~held])
        p, limits = trees.probability(x), {}
        for kind in KINDS:
            own = held & (kinds == kind)
            fit = [t for t in np.arange(0.5, 1.0, 0.01) if (hit := own & (p >= t)).any() and y[hit].mean() >= LEAST_PRECISION]
            limits[kind] = float(fit[0]) if fit else 1.1
        _models[key] = trees, limits
    return _models[key]


# -- selection --------------------------------------------------------------------------------
_ONE = "struct<start:int,end:int,kind:string,p:double>"
_ADDED = f"array<{_ONE}>"


def _apart(proposed: Column, taken: Column) -> Column:
    """The proposals that overlap none of the spans in ``taken``: one pass for those that begin before, one for those after."""
    void = F.lit(None).cast(_ONE)
    fixed = F.transform(taken, lambda c: F.struct(c["start"].alias("start"), F.lit(0).alias("rank"), c["end"].alias("end"), void.alias("c")))
    loose = F.transform(proposed, lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("rank"), c["end"].alias("end"), c.alias("c")))

    def after(reach: Column, x: Column) -> tuple[Column, Column]:
        none = F.lit(None).cast(f"struct<start:int,rank:int,end:int,c:{_ONE}>")
        return F.when(x["rank"] == 0, F.greatest(reach, x["end"])).otherwise(reach), F.when((x["rank"] == 0) | (x["start"] >= reach), x).otherwise(none)

    def before(begin: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["rank"] == 0, x["start"]).otherwise(begin), F.when((x["rank"] == 1) & (x["end"] <= begin), x["c"]).otherwise(void)

    ordered = F.array_sort(F.concat(fixed, loose), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]))
    ahead = F.array_compact(F.flatten(_scan(ordered, F.lit(0), after, f"struct<start:int,rank:int,end:int,c:{_ONE}>")["out"]))
    back = F.array_compact(F.flatten(_scan(F.reverse(ahead), F.lit((1 << 31) - 1), before, _ONE)["out"]))
    return F.when(F.size(taken) > 0, back).otherwise(proposed)


def _likeliest(spans: Column) -> Column:
    """Of spans that overlap the one before, in order of their start, the one of higher probability."""
    none = F.lit(None).cast(_ONE)

    def step(last: Column, c: Column) -> tuple[Column, Column]:
        free = last.isNull() | (c["start"] >= last["end"])
        return F.when(free | (c["p"] > last["p"]), c).otherwise(last), F.when(free, last).otherwise(none)

    return _once(_scan(F.array_sort(spans), none, step, _ONE), lambda r: F.array_compact(F.concat(F.flatten(r["out"]), F.array(r["state"]))))


# -- operator ---------------------------------------------------------------------------------
def find(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text``, a column ``base_<kind>`` of each fixed format and ``added``, arrays of spans."""
    trees, limits = model(docs.sparkSession)
    kept = [docs[c].alias(f"kept_{c}") for c in keep]
    rows = docs.select(*kept, *[docs[id_column].alias("doc_id"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text")]) if keep else rows_of(docs, id_column, text_column)
    text = F.col("text")
    base = {}
    for kind, (pattern, needs) in _BASE.items():
        spans = F.filter(_marked(text, pattern, needs), _passes(kind))
        base[kind] = F.transform(spans, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))
    rows = rows.select("*", *[spans.alias(f"base_{kind}") for kind, spans in base.items()])
    taken = F.concat(*[F.col(f"base_{kind}") for kind in BASE_KINDS])

    def selected(kind: str, found: Column) -> Column:
        known = F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.array(*_features(c, kind)).alias("f")))
        judged = F.transform(
            known,
            lambda c: F.struct(
                c["start"].alias("start"),
                c["end"].alias("end"),
                F.lit(kind).alias("kind"),
                trees.column([F.get(c["f"], F.lit(i)) for i in range(FEATURES)]).alias("p"),
            ),
        )
        return F.filter(judged, lambda c: c["p"] >= limits[kind])

    proposed = [selected(kind, found) for kind, found in _proposals(text)]
    rows = rows.select("*", F.concat(*proposed).alias("proposed"), taken.alias("taken"))
    added = F.when(F.size("proposed") > 0, _likeliest(_apart(F.col("proposed"), F.col("taken")))).otherwise(F.array().cast(_ADDED))
    return rows.select(*[f"kept_{c}" for c in keep], "doc_id", "text", *[f"base_{kind}" for kind in BASE_KINDS], added.alias("added"))


def _text(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda c: F.concat(F.lit(f"{kind}:"), c["start"].cast("string"), F.lit(":"), c["end"].cast("string")))


def spans_of(kind: str) -> Column:
    """All spans of a kind in a table of ``find``, in order."""
    added = F.transform(F.filter("added", lambda c: c["kind"] == kind), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))
    return F.sort_array(F.concat(F.col(f"base_{kind}"), added)) if kind in BASE_KINDS else F.sort_array(added)


def summary(found: DataFrame) -> DataFrame:
    """``doc_id``, counts of the fixed formats, ``base_sha256`` and all ``spans`` as text."""
    base = F.array_join(F.concat(*[_text(kind, F.col(f"base_{kind}")) for kind in BASE_KINDS]), ",")
    every = F.array_join(F.concat(*[_text(kind, spans_of(kind)) for kind in KINDS]), ",")
    counts = [F.size(f"base_{kind}").cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def redacted() -> Column:
    """The text of a table of ``find`` with ``[KIND]`` in the place of spans; overlapping spans are one, under the first's kind."""

    def tagged(kind: str) -> Column:
        tag = F.lit(f"[{kind.upper()}]").alias("tag")
        return F.transform(spans_of(kind), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), tag))

    def cut(parts: Column, low: Column, high: Column) -> Column:
        i, j = (F.floor(x / PART).cast("int") for x in (low, high))
        first = F.substring(F.get(parts, i), low % PART + 1, F.when(i == j, high - low).otherwise(PART))
        rest = F.concat(F.array_join(F.slice(parts, i + 2, j - i - 1), ""), F.coalesce(F.substring(F.get(parts, j), F.lit(1), high % PART), F.lit("")))
        return F.concat(F.coalesce(first, F.lit("")), F.when(i == j, F.lit("")).otherwise(rest))

    def whole(parts: Column) -> Column:
        def step(at: Column, c: Column) -> tuple[Column, Column]:
            inside = c["start"] < at
            return F.greatest(at, c["end"]), F.when(inside, F.lit("")).otherwise(F.concat(cut(parts, at, c["start"]), c["tag"]))

        done = _scan(F.array_sort(F.concat(*map(tagged, KINDS))), F.lit(0), step, "string")
        return _once(done, lambda r: F.concat(F.array_join(F.flatten(r["out"]), ""), cut(parts, r["state"], F.length("text"))))

    some = reduce(lambda a, b: a | b, [F.size(f"base_{kind}") > 0 for kind in BASE_KINDS]) | (F.size("added") > 0)
    return F.when(some, _once(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), whole)).otherwise(F.col("text"))
