"""Personal data by weak supervision (operator 7), in DataFrame functions only.

Patterns propose spans: the strict ones of each kind, with those that fail their check, and wider forms
(spelled-out addresses, numbers without a country code, other separators, IPv6). Three labelers vote on each
span: the pattern's own check, a gazetteer (top-level domains, issuer and country prefixes, address ranges) and
the context around it. Expectation-maximisation over the counts of vote patterns estimates each labeler's
reliability; a naive Bayes classifier on the span's form is trained on those posteriors and decides. Strict
spans that pass their check always stay; wider ones are added where the classifier says so.

All counting is done by aggregation over all documents. What reaches the driver is one row for each kind, vote
pattern and form: a fixed number of combinations, whatever the corpus.

Positions are code points, the end exclusive. They come from the lengths of the gaps (split) and matches
(regexp_extract_all) of one pattern. Edge cases: null and empty texts have no spans; repeated rows are treated
alike; an empty table gives an empty table; a text of many thousand matches costs near-linear work.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, with_text

KINDS = ("email", "ip", "card", "phone")
#: Strict patterns, as possessive forms with the same matches: no deep recursion, no quadratic scan.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)| at |@) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]{2,24}){1,5}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20./_-]{2}|[./_])[0-9]{4}(?:[\x20./_-]{2}|[./_])[0-9]{4}(?:[\x20./_-]{2}|[./_])[0-9]{4}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
#: Cheap conditions without which a pattern cannot match.
STRICT_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){9}", "phone": r"\+[0-9]"}
WIDE_NEEDS = {"email": r"(?:\[dot\]|\(dot\)| dot )", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9]{4}[\x20./_-]{1,2}[0-9]{4}", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}
#: Gazetteer. Common generic top-level domains (country domains are any two letters), calling codes by
#: zone as the international numbering plan assigns them, and issuer prefixes with their lengths.
TLDS = (
    "com|org|net|edu|gov|mil|int|info|biz|name|pro|aero|coop|museum|mobi|jobs|travel|tel|cat|asia|post|app|dev|blog|shop|store|online|site|tech|cloud|email|news|media|agency|xyz|club|live|world|today|life|"
    "group|company|solutions|services|systems|network|digital|software|studio|design|academy|school|university|institute|foundation|health|care|law|bank|finance|example|test"
)
DOMAINS = f"^(?:[a-z]{{2}}|{TLDS})$"
CALLING = "(?:1|7|2(?:0|7|[1-69][0-9])|3(?:[0-469]|[578][0-9])|4(?:[013-9]|2[0-9])|5(?:[1-8]|[09][0-9])|6(?:[0-6]|[7-9][0-9])|8(?:[1246]|[05789][0-9])|9(?:[0-58]|[679][0-9]))"
ISSUERS = r"^(?:4[0-9]{15}|4[0-9]{18}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[068][0-9]{12}|35[2-8][0-9]{13}|6011[0-9]{12}|64[4-9][0-9]{13}|65[0-9]{14}|62[0-9]{14,17}|(?:50|5[6-9]|6[37])[0-9]{12,17})$"
#: Context words of English, German, French and Spanish that announce each kind.
CUES = {
    "email": "mail|contact|write|reach|address|inbox|send|kontakt|schreib|adresse|correo|escrib|contacto|courriel|écri|contactez",
    "ip": "\\bip\\b|ipv[46]|host|server|addr|gateway|subnet|client|peer|rechner|servidor|serveur|adresse|dirección",
    "card": "card|visa|master|amex|credit|debit|payment|karte|zahlung|carte|paiement|tarjeta|crédito|pago",
    "phone": "phone|tel|call|fax|mobil|cell|ring|dial|fon|ruf|anruf|handy|appel|portable|teléfono|llam|móvil",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
BLOCK = 128


def _let(value: Column, use) -> Column:
    """Evaluate value once and use it by name."""
    return F.transform(F.array(value), use)[0]


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return _total(F.transform(F.sequence(F.lit(1), F.length(digits)), worth)) % 10 == 0


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _passes(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(f"^{_BYTE}(?:\\.{_BYTE}){{3}}$")
    n = F.length(_digits(hit))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(_digits(hit))).otherwise(F.lit(False))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _spans(text: Column, kind: str, wide: bool) -> Column:
    """All matches of a pattern as structs, ordered by position."""
    regex, needs = (WIDE, WIDE_NEEDS) if wide else (STRICT, STRICT_NEEDS)

    def place(x: Column) -> Column:
        gaps, hits = x["gaps"], x["hits"]

        def at(lengths: Column, blocks: Column) -> Column:
            def span(hit: Column, i: Column) -> Column:
                gap = F.get(gaps, i)
                low = F.floor(i / BLOCK).cast("int")
                start = F.get(blocks, low) + _total(F.slice(lengths, low * BLOCK + 1, i % BLOCK)) + F.length(gap)
                return F.struct(
                    start.alias("s"), F.lit(KINDS.index(kind)).alias("k"), (start + F.length(hit)).alias("e"), F.lit(wide).alias("wide"),
                    (_passes(kind, hit) if not wide else F.lit(False)).alias("base"), hit.alias("hit"), F.right(gap, F.lit(32)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("right"),
                )

            return F.transform(hits, span)

        lengths = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda m, g: F.length(m) + F.length(g))
        return _let(lengths, lambda n: _let(F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / BLOCK).cast("int")), lambda b: _total(F.slice(n, F.lit(1), b * BLOCK))), lambda b: at(n, b)))

    found = _let(F.struct(F.split(text, regex[kind], -1).alias("gaps"), F.regexp_extract_all(text, F.lit(regex[kind]), F.lit(0)).alias("hits")), place)
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int,wide:boolean,base:boolean,hit:string,left:string,right:string>>)")
    return F.when(text.rlike(needs[kind]), found).otherwise(none)


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(_row, _text, _base, _other): the row as a struct, the sorted strict spans that pass, and the rest of the
    spans without what overlaps one of those."""
    text = F.col("_text")
    out = docs.select(F.struct(*docs.columns).alias("_row"), with_text(docs, text_col).alias("_text"))
    out = out.withColumn("_strict", F.concat(*(_spans(text, k, False) for k in KINDS))).withColumn("_wide", F.concat(*(_spans(text, k, True) for k in KINDS)))
    out = out.withColumn("_base", F.sort_array(F.filter("_strict", lambda x: x["base"])))
    free = F.filter(F.concat(F.filter("_strict", lambda x: ~x["base"]), F.col("_wide")), lambda x: ~F.exists("_base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return out.withColumn("_other", F.when((F.size("_wide") > 0) | (F.size("_strict") > F.size("_base")), free).otherwise(F.filter("_strict", lambda x: F.lit(False)))).drop("_strict", "_wide")


def _kind(x: Column, of: dict[str, Column]) -> Column:
    out = F.lit(0)
    for k, value in of.items():
        out = F.when(x["k"] == KINDS.index(k), value).otherwise(out)
    return out


def votes(x: Column) -> list[Column]:
    """The three labelers: 1 for personal data, -1 against, 0 for no opinion."""
    hit, digits = x["hit"], _digits(x["hit"])
    sign = lambda c: F.when(c, 1).otherwise(-1)
    checked = F.when(x["base"], 1).when(~x["wide"], -1).otherwise(_kind(x, {"email": F.lit(0), "ip": F.lit(1), "card": sign(_luhn(digits)), "phone": F.lit(0)}))
    listed = _kind(x, {
        "email": sign(F.lower(F.regexp_extract(hit, "([A-Za-z]+)$", 1)).rlike(DOMAINS)),
        "ip": F.when(hit.contains(":"), 1).otherwise(sign(~hit.rlike("^(?:0|127|22[4-9]|2[3-5][0-9])\\."))),
        "card": sign(digits.rlike(ISSUERS)),
        "phone": F.when(hit.startswith("+"), sign(digits.rlike(f"^{CALLING}"))).when(x["wide"], sign(digits.rlike("^[2-9]"))).otherwise(0),
    })
    cue = _kind(x, {k: F.when(F.lower(x["left"]).rlike(words), 1).otherwise(0) for k, words in CUES.items()})
    context = F.when(cue == 1, 1).when(x["left"].rlike("[A-Za-z0-9]$") | x["right"].rlike("^[A-Za-z0-9]"), -1).otherwise(0)
    return [checked, listed, context]


def form(x: Column) -> list[Column]:
    """The classifier's features, each with a few values: origin, length, digits, neighbours."""
    side = lambda c: F.when(c == "", "none").when(c.rlike("[\\s]"), "space").when(c.rlike("[A-Za-z0-9]"), "word").otherwise("mark")
    return [
        F.concat(x["wide"].cast("string"), x["base"].cast("string")),
        F.least(F.floor(F.length(x["hit"]) / 4), F.lit(12)).cast("string"),
        F.least(F.length(_digits(x["hit"])), F.lit(20)).cast("string"),
        side(F.right(x["left"], F.lit(1))),
        side(x["right"]),
    ]


def reliabilities(counts: dict[tuple[int, tuple[int, ...]], int], rounds: int = 60) -> dict[tuple[int, tuple[int, ...]], float]:
    """Posterior of each (kind, vote pattern) by EM; labelers are independent given the truth.

    A failed check is known to be no personal data, so such patterns keep their posterior.
    """
    after = {key: min(0.95, max(0.05, 0.5 + 0.2 * sum(key[1]))) for key in counts}
    for _ in range(rounds):
        mass: dict = defaultdict(lambda: 0.5)
        for (kind, pattern), n in counts.items():
            p = after[kind, pattern]
            for y, w in ((1, p), (0, 1 - p)):
                mass[y, kind] += n * w
                for j, v in enumerate(pattern):
                    mass[y, kind, j, v] += n * w
        for kind, pattern in counts:
            if pattern[0] < 0:
                after[kind, pattern] = 0.01
                continue
            log = {y: math.log(mass[y, kind]) + sum(math.log(mass[y, kind, j, v] / (mass[y, kind] + 1)) for j, v in enumerate(pattern)) for y in (0, 1)}
            after[kind, pattern] = 1 / (1 + math.exp(min(50, max(-50, log[0] - log[1]))))
    return after


def train(found: DataFrame) -> dict[tuple[int, int, str], float]:
    """Log-odds of each (kind, feature, value); feature -1 holds the kind's prior."""
    spans = found.select(F.explode(F.concat("_base", "_other")).alias("x"))
    v, f = votes(F.col("x")), form(F.col("x"))
    table = spans.groupBy(F.col("x")["k"].alias("k"), *(c.alias(f"v{i}") for i, c in enumerate(v)), *(c.alias(f"f{i}") for i, c in enumerate(f))).count().collect()
    counts: dict = defaultdict(int)
    for r in table:
        counts[r["k"], tuple(r[f"v{i}"] for i in range(len(v)))] += r["count"]
    after = reliabilities(counts)
    mass: dict = defaultdict(lambda: 0.5)
    values: set = set()
    for r in table:
        p = after[r["k"], tuple(r[f"v{i}"] for i in range(len(v)))]
        for y, w in ((1, p * r["count"]), (0, (1 - p) * r["count"])):
            mass[y, r["k"]] += w
            for i in range(len(f)):
                mass[y, r["k"], i, r[f"f{i}"]] += w
                values.add((r["k"], i, r[f"f{i}"]))
    odds = {(k, -1, ""): math.log(mass[1, k] / mass[0, k]) for k in {r["k"] for r in table}}
    return odds | {(k, i, x): math.log(mass[1, k, i, x] / (mass[1, k] + 1)) - math.log(mass[0, k, i, x] / (mass[0, k] + 1)) for k, i, x in values}


def _decides(odds: dict[tuple[int, int, str], float], x: Column) -> Column:
    """True where the log-odds of a span's form are positive."""
    if not odds:
        return F.lit(False)
    table = F.create_map(*(F.lit(y) for (k, i, value), w in odds.items() for y in (f"{k}:{i}:{value}", float(w))))
    key = lambda i, value: F.concat(x["k"].cast("string"), F.lit(f":{i}:"), value)
    score = F.coalesce(F.try_element_at(table, key(-1, F.lit(""))), F.lit(-1.0))
    for i, value in enumerate(form(x)):
        score = score + F.coalesce(F.try_element_at(table, key(i, value)), F.lit(0.0))
    return score > 0


def _found(docs: DataFrame, text_col: str, odds: dict[tuple[int, int, str], float] | None) -> DataFrame:
    """(_row, _text, _base_spans, _spans)."""
    found = candidates(docs, text_col)
    odds = train(found) if odds is None else odds
    bare = lambda spans: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    found = found.withColumn("_base_spans", bare("_base"))
    more = F.when(F.size("_other") > 0, bare(F.filter("_other", lambda x: (votes(x)[0] >= 0) & _decides(odds, x)))).otherwise(F.slice("_base_spans", 1, 0))
    return found.select("_row", "_text", "_base_spans", F.sort_array(F.concat("_base_spans", more)).alias("_spans"))


def find_pii(docs: DataFrame, text_col: str = "text", odds: dict[tuple[int, int, str], float] | None = None) -> DataFrame:
    """Every row with base_spans and spans (made fresh if taken): sorted arrays of struct<s, k, e>, k in KINDS.

    Without a given model, one is trained on all rows first; that is a second pass over the texts.
    """
    base, spans = fresh(docs, "base_spans", "spans")
    return _found(docs, text_col, odds).select("_row.*", F.col("_base_spans").alias(base), F.col("_spans").alias(spans))


def spelled(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    name = lambda k: F.get(F.array(*(F.lit(x) for x in KINDS)), k)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", odds: dict[tuple[int, int, str], float] | None = None) -> DataFrame:
    """Every row with its spans replaced by <kind>; spans that overlap are replaced as one, named by the first."""
    text = F.col("_text")
    # _spans are sorted: each is given the furthest end up to it, and a union ends where the next span starts no earlier
    ends = F.transform("_spans", lambda x, i: x["e"])
    none = F.struct(F.slice(ends, 1, 0).alias("all"), F.lit(0).alias("end"))
    reach = F.aggregate(ends, none, lambda a, e: F.struct(F.array_append(a["all"], F.greatest(a["end"], e)).alias("all"), F.greatest(a["end"], e).alias("end")), lambda a: a["all"])

    def unions(reach: Column) -> Column:
        heads = F.filter(F.transform("_spans", lambda x, i: F.struct(x["s"].alias("s"), x["k"].alias("k"), i.alias("i"))), lambda x: (x["i"] == 0) | (x["s"] >= F.get(reach, x["i"] - 1)))
        return _let(heads, lambda h: F.transform(h, lambda x, j: F.struct(x["s"].alias("s"), x["k"].alias("k"), F.get(reach, F.coalesce(F.get(h, j + 1)["i"], F.size(reach)) - 1).alias("e"))))

    clear = _let(reach, unions)
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))

    def rebuilt(kept: Column) -> Column:
        pieces = F.transform(kept, lambda x, i: F.concat(F.substring(text, F.coalesce(F.get(kept, i - 1)["e"], F.lit(0)) + 1, x["s"] - F.coalesce(F.get(kept, i - 1)["e"], F.lit(0))), F.get(names, x["k"])))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.get(kept, F.size(kept) - 1)["e"] + 1, F.length(text)))

    done = _found(docs, text_col, odds).withColumn("_new", F.when(F.size("_spans") > 0, _let(clear, rebuilt)).otherwise(text))
    return done.select(*(F.col("_new").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns))
