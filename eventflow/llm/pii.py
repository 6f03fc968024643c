"""Personal data by weak supervision, with DataFrame operations only.

Exact patterns give the base spans. Wider patterns give candidates besides (masked
e-mails, defanged and IPv6 addresses, phone numbers without a plus sign, unproven card
numbers). Labelers look at each span: its shape and grouping (regex), known prefixes and
endings (gazetteer), words around it (context); each votes yes, no or nothing. From the
counts of vote patterns, expectation-maximisation estimates how far each labeler can be
trusted and how likely each span is personal data; a logistic classifier of the spans'
features is fitted to these probabilities and decides about the candidates. Base spans stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventflow.llm.common import text_of, written

#: In the order of the results.
KINDS = ("email", "ip", "card", "phone")

# Fixed patterns of the base spans. Possessive forms and the look-behind only keep a long run from being read twice.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns of candidates, each with bounded parts.
LOOSE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+(?:\x20at\x20|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]{{1,63}}+"
    r"(?:(?:\x20dot\x20|\x20?[(\[]dot[)\]]\x20?|\.)[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)|\x20dot\x20)[0-9]{1,3}+){3}+(?![0-9])"
    r"|(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}+(?![0-9A-Za-z:])",
    "number": r"(?<![0-9A-Za-z+])\(?[0-9](?:[\x20().-]{0,2}+[0-9]){6,18}+(?![0-9A-Za-z])",
}
#: A text without these holds no match of the pattern.
NEEDS = {"email": ["@"], "phone": ["+"], "loose email": [" at ", "(at)", "[at]"], "loose ip": ["[.]", "(.)", " dot ", ":"]}
#: Code points of the surroundings that labelers see.
BEFORE, AFTER = 40, 12

_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Fixed lists of the gazetteer.
ENDINGS = "com|org|net|edu|gov|info|biz|io|de|fr|es|uk|it|nl|at|ch|eu|us|ca|mx|ar|br|in|jp|cn|au"
ISSUERS = "4|5[1-5]|2[2-7]|3[0-9]|6011|65|64[4-9]|62"
CUES = {
    "email": "e-?mail|mail|correo|courriel|contact|write|reply",
    "ip": r"\bip\b|host|server|address|adresse|login|ping",
    "card": "card|visa|master|amex|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|cell|handy|ring|appel",
}
OTHERS = r"order|invoice|isbn|issn|version|serial|ticket|\bref|\bid\b|\bno\.?|number of|page|#|\$|€|£|token|="
LABELERS = ("shape", "grouping", "known", "cue", "other", "after")
FEATURES = ("kind", *LABELERS, "digits", "separator", "left", "right")
YES, NO, SILENT = "y", "n", "-"


def _matches(text: Column, name: str, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if name not in NEEDS:
        return found
    some = F.lit(False)
    for part in NEEDS[name]:
        some = some | F.contains(text, F.lit(part))
    return F.when(some, found).otherwise(F.array().cast("array<string>"))


def _named_patterns() -> dict[str, str]:
    return {**BASE, **{f"loose {name}": pattern for name, pattern in LOOSE.items()}}


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, row, and the matches of all patterns in order, each with the text between them.

    ``gap`` counts the code points since the pattern's last match; a match's place is the sum of what lies before it.
    """
    patterns = _named_patterns()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("*", *[_matches(F.col("body"), name, p).alias(f"m {name}") for name, p in patterns.items()])
    gaps = [
        F.when(F.size(f"m {name}") > 0, F.split("body", pattern, -1)).otherwise(F.array().cast("array<string>")).alias(f"g {name}")
        for name, pattern in patterns.items()
    ]
    rows = rows.select("*", *gaps)
    return written(rows.select("id", "row", F.concat(*map(_spans, patterns)).alias("spans")), "pii-found")


def _spans(name: str) -> Column:
    """The matches of one pattern with what surrounds them; the gaps hold the rest of the text."""
    matches, gaps = F.col(f"m {name}"), F.col(f"g {name}")
    left = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.struct(m.alias("match"), g.alias("gap")))

    def shaped(span: Column, rest: Column) -> Column:
        return F.struct(
            F.lit(name).alias("pattern"),
            F.length(span["gap"]).alias("gap"),
            F.length(span["match"]).alias("size"),
            span["match"].alias("match"),
            F.lower(F.right(span["gap"], F.lit(BEFORE))).alias("before"),
            F.left(rest, F.lit(AFTER)).alias("after"),
        )

    return F.zip_with(left, F.slice(gaps, F.lit(2), F.size(matches)), shaped)


def _vote(yes: Column | bool, no: Column | bool) -> Column:
    return F.when(F.lit(yes) if isinstance(yes, bool) else yes, YES).when(F.lit(no) if isinstance(no, bool) else no, NO).otherwise(SILENT)


def _by_kind(choices: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(F.col("kind") == kind, column) for kind, column in choices.items()])


def _char_class(char: Column) -> Column:
    return (
        F.when(char == "", "edge").when(char.rlike(r"^\s"), "space").when(char.rlike("^[0-9]"), "digit").when(char.rlike(r"^\p{L}"), "letter")
    ).otherwise("mark")


def labeled(rows: DataFrame) -> DataFrame:
    """One row per span: row, kind, base, start, end, the labelers' votes and the classifier's features.

    Kept are base spans that pass their kind's test, and candidates that overlap none of them.
    """
    spans = rows.select("row", F.posexplode("spans").alias("at", "span")).select("row", "at", "span.*").repartition("row")
    upto = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "pattern").orderBy("at")).cast("long")
    digits = F.regexp_replace("match", "[^0-9]", "")
    spans = spans.withColumns({"end": upto, "digits_only": digits, "base": ~F.col("pattern").startswith("loose")})
    n_digits = F.length("digits_only")
    number = F.when(n_digits >= 13, "card").otherwise("phone")
    kind = F.when(F.col("pattern") == "loose number", number).otherwise(F.regexp_replace("pattern", "^loose ", ""))
    spans = spans.select("*", kind.alias("kind"), (F.col("end") - F.col("size")).alias("start"))
    plain = F.regexp_replace("match", r"\[\.\]|\(\.\)| dot ", ".")
    address = plain.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    luhn = n_digits.between(13, 19) & F.call_function("luhn_check", F.col("digits_only"))
    valid = _by_kind({"email": F.lit(True), "ip": address, "card": luhn, "phone": n_digits.between(9, 15)})
    spans = spans.where(~F.col("base") | valid)

    # In the order of the starts, base spans first; a candidate must lie between the last end before it and the next start.
    in_text = Window.partitionBy("row").orderBy("start", F.col("base").desc(), "end")
    ended = F.max(F.when(F.col("base"), F.col("end"))).over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    backwards = Window.partitionBy("row").orderBy(F.col("start").desc(), "base", F.col("end").desc())
    next_start = F.min(F.when(F.col("base"), F.col("start"))).over(backwards.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumns({"ended": ended, "next_start": next_start})
    free = (F.coalesce("ended", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next_start"), F.col("end")) >= F.col("end"))
    spans = spans.where(F.col("base") | free)

    near = F.right("before", F.lit(16))
    loose, match, is_v6 = ~F.col("base"), F.col("match"), F.col("match").contains(":")
    masked = match.rlike(r"(?:[(\[]at[)\]]| at ).*(?:[(\[]dot[)\]]| dot )")
    votes = {
        "shape": _by_kind(
            {
                "email": _vote(F.col("base"), False),
                "ip": _vote(address, ~address & ~is_v6),
                "card": _vote(luhn, ~luhn),
                "phone": _vote(F.col("base"), False),
            }
        ),
        "grouping": _by_kind(
            {
                "email": _vote(masked, False),
                "ip": F.lit(SILENT),
                "card": _vote(match.rlike(r"^[0-9]{4}(?:[ .-]?[0-9]{4}){3}$|^[0-9]{4}[ .-]?[0-9]{6}[ .-]?[0-9]{5}$"), True),
                "phone": _vote(
                    match.rlike(r"^(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}$"),
                    match.rlike(r"^[0-9]+$|^[0-9]{4}[ .-][0-9]{2}[ .-][0-9]{2}|^[0-9]{2}[.-][0-9]{2}[.-][0-9]{4}"),
                ),
            }
        ),
        "known": _by_kind(
            {
                "email": _vote(F.lower("match").rlike(rf"[^a-z](?:{ENDINGS})$"), True),
                "ip": _vote(~is_v6 & ~F.col("digits_only").rlike("^0"), ~is_v6),
                "card": _vote(F.col("digits_only").rlike(f"^(?:{ISSUERS})"), True),
                "phone": _vote(F.col("digits_only").rlike("^[2-9]") | (F.col("base") & F.col("digits_only").rlike("^1")), True),
            }
        ),
        "cue": _by_kind({k: _vote(F.col("before").rlike(cue), False) for k, cue in CUES.items()}),
        "other": _vote(False, near.rlike(OTHERS)),
        "after": _vote(False, F.lower("after").rlike(r"^(?: ?(?:%|kg|km|cm|mm|eur|usd|€|\$|£)|[a-z0-9_])")),
    }
    marks = F.regexp_replace("match", "[^ ().-]", "")
    separator = F.when(marks == "", "none").when(marks.rlike("^ +$"), "space").when(marks.rlike("^-+$"), "hyphen").when(marks.rlike(r"^\.+$"), "dot")
    bucket = F.when(n_digits == 0, "0").when(n_digits < 7, "1").when(n_digits < 9, "7").when(n_digits < 13, "9").when(n_digits < 16, "13")
    features = {
        "digits": bucket.otherwise("16"),
        "separator": separator.otherwise("mixed"),
        "left": _char_class(F.right("before", F.lit(1))),
        "right": _char_class(F.left("after", F.lit(1))),
    }
    names = [c.alias(n) for n, c in (votes | features).items()]
    return written(spans.select("row", "kind", "base", "start", "end", *names), "pii-spans")


@dataclass
class Reliability:
    """What expectation-maximisation found: the share of personal data by kind, and P(yes | truth, voted) by kind and labeler."""

    share: dict[str, float]
    says_yes: dict[tuple[str, str], tuple[float, float]]

    def log_odds(self) -> Column:
        """Of a span being personal data, given its votes."""
        by_kind = {k: math.log(p / (1 - p)) for k, p in self.share.items()}
        total = _weight_of(by_kind, F.col("kind"))
        for labeler in LABELERS:
            weights = {}
            for kind in KINDS:
                no_data, data = self.says_yes[kind, labeler]
                weights[kind + YES], weights[kind + NO] = math.log(data / no_data), math.log((1 - data) / (1 - no_data))
            total = total + _weight_of(weights, F.concat("kind", labeler))
        return total


def _weight_of(weights: dict[str, float], key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*map(F.lit, chain(*weights.items()))), key), F.lit(0.0))


#: Votes that each labeler is taken to have cast before any is seen: (right, wrong). They keep the meaning of "yes".
PRIOR = (4.0, 1.0)


def estimate(counts: list[tuple[str, bool, tuple[str, ...], int]], rounds: int = 200) -> Reliability:
    """Reliabilities from the counts of (kind, base, votes): expectation-maximisation on the vote patterns.

    Base spans are personal data by definition; of the others the truth is hidden. A
    silent labeler says nothing. The patterns are few whatever the data's size: at most three votes
    to the power of the labelers, for each kind.
    """
    says = {(k, lab): (PRIOR[1] / sum(PRIOR), PRIOR[0] / sum(PRIOR)) for k in KINDS for lab in LABELERS}
    share = {k: 0.5 for k in KINDS}
    for _ in range(rounds):
        hidden = {k: [1.0, 1.0] for k in KINDS}
        cast = {key: [[PRIOR[0], PRIOR[1]], [PRIOR[1], PRIOR[0]]] for key in says}  # [truth][vote], vote 1 is yes
        for kind, base, votes, n in counts:
            odds = math.log(share[kind] / (1 - share[kind]))
            for labeler, vote in zip(LABELERS, votes):
                no_data, data = says[kind, labeler]
                if vote != SILENT:
                    odds += math.log(data / no_data) if vote == YES else math.log((1 - data) / (1 - no_data))
            p = 1.0 if base else 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            if not base:
                hidden[kind][0] += n * (1 - p)
                hidden[kind][1] += n * p
            for labeler, vote in zip(LABELERS, votes):
                if vote != SILENT:
                    cast[kind, labeler][0][vote == YES] += n * (1 - p)
                    cast[kind, labeler][1][vote == YES] += n * p
        before = says
        share = {k: data / (no_data + data) for k, (no_data, data) in hidden.items()}
        says = {key: tuple(truth[1] / (truth[0] + truth[1]) for truth in both) for key, both in cast.items()}
        if max(abs(a - b) for key in says for a, b in zip(says[key], before[key])) < 1e-7:
            break
    return Reliability(share, says)


def _terms() -> dict[str, Column]:
    """What the classifier sees of a span, each within its kind."""
    return {name: F.concat("kind", F.lit(":"), name) if name != "kind" else F.col("kind") for name in FEATURES}


def fit(spans: DataFrame, reliability: Reliability, ridge: float = 1.0) -> Column:
    """The classifier's log-odds as a column: logistic regression on the spans' features, targets from the votes.

    Spark sums spans and targets by feature pattern; the few patterns are fitted by Newton's method.
    """
    p = F.when(F.col("base"), 1.0).otherwise(1 / (1 + F.exp(-reliability.log_odds())))
    terms = {name: term.alias(f"t_{name}") for name, term in _terms().items()}
    groups = spans.select(*terms.values(), p.alias("p")).groupBy(*[f"t_{n}" for n in terms]).agg(F.count("*").alias("n"), F.sum("p").alias("p"))
    rows = groups.collect()  # bounded: one row for each pattern of features
    if not rows:
        return F.lit(0.0)
    names = sorted({(f, r[f"t_{f}"]) for r in rows for f in FEATURES})
    place = {name: i for i, name in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [place[f, r[f"t_{f}"]] for f in FEATURES]] = 1
    n, target = np.array([r["n"] for r in rows], float), np.array([r["p"] for r in rows])
    weights = np.zeros(len(names))
    for _ in range(30):
        fitted = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (n * fitted - target) + ridge * weights
        bend = (x.T * (n * fitted * (1 - fitted))) @ x + ridge * np.eye(len(names))
        step = np.linalg.solve(bend, slope)
        weights -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    total = F.lit(0.0)
    for feature, term in _terms().items():
        total = total + _weight_of({value: float(weights[i]) for (f, value), i in place.items() if f == feature}, term)
    return total


def decided(spans: DataFrame) -> DataFrame:
    """The spans that are personal data: all base spans, and the candidates that the classifier takes."""
    counts = spans.groupBy("kind", "base", *LABELERS).agg(F.count("*").alias("n")).collect()  # bounded, see estimate
    reliability = estimate([(r["kind"], r["base"], tuple(r[v] for v in LABELERS), r["n"]) for r in counts])
    return spans.where(F.col("base") | (fit(spans, reliability) > 0))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, base and spans, arrays of (kind, start, end) in the order of KINDS, then of starts.

    Places are code points, ends exclusive. A null text counts as empty; null ids and
    repeated rows are rows like any other; an empty table has an empty result.
    """
    rows = found(docs, id_col, text_col)
    order = F.create_map(*map(F.lit, chain(*((k, i) for i, k in enumerate(KINDS)))))
    span = F.struct(order[F.col("kind")].alias("rank"), "start", "end", "kind")
    texts = decided(labeled(rows)).groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.sort_array(F.collect_list(span)).alias("spans")
    )
    shaped = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    texts = texts.select("row", shaped("base").alias("base"), shaped("spans").alias("spans"))
    none = F.array().cast(texts.schema["spans"].dataType)
    joined = rows.select("id", "row").join(texts, "row", "left")
    return joined.select("id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
