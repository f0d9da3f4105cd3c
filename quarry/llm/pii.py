"""Personal data by weak supervision, by DataFrame functions only.

Labelers (patterns, shapes, gazetteers and context words) vote on candidate spans. The counts of
the vote patterns, a table bounded by the votes and not by the corpus, give the labelers'
reliabilities by expectation-maximisation, and with its posteriors as soft labels a naive Bayes
classifier of span features, which decides on the candidates that the base rules leave out.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quarry.llm.common import stored, whole_text
from quarry.llm.spans import listed, with_spans

ROUNDS = 30
ACCEPT = 0.5

# The base kinds. A run is entered at its first character or where the last match
# ended, and is not given back; that finds the same leftmost matches in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9])++",
}
# Further candidates: written-out addresses, national phone numbers, social security numbers and
# account numbers.
MORE = {
    "mailat": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]{1,63}+){1,8}+",
    "local": r"(?<![0-9+().\x20-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
KINDS = (*BASE, *MORE)
ENDINGS = "com|net|org|edu|gov|mil|int|info|biz|io|co|eu|uk|us|de|fr|es|it|nl|be|at|ch|pl|pt|se|no|dk|fi|ie|cz|jp|cn|in|br|mx|ca|au|ru"
CALLING = "1|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|57|60|61|62|63|64|65|66|7|81|82|84|86|90|91|92|93|94|95|98"
COUNTRIES = "AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|RO|SE"
CUES = r"(?i)\b(?:e-?mail|mail|contact|call|phone|tel|telephone|fax|mobile|card|visa|ip|address|host|ssn|iban|account|reach|write|kontakt|telefon|correo|courriel|karte|tarjeta|carte)\b"
AGAINST = r"(?i)\b(?:version|release|build|ver|figure|fig|table|chapter|section|isbn|issn|order|item|page|line|no)\.?[\x20:#]*$"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the Luhn check; the last one is the check digit."""
    doubled = F.transform(
        F.split(F.reverse(number), ""),
        lambda d, i: F.when(i % 2 == 1, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0))) % 10 == 0


def _parts_fit(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda part: F.length(F.ltrim(part, F.lit("0"))) <= 3) & F.forall(
        F.split(value, r"\."), lambda part: F.coalesce(F.right(part, F.lit(4)).cast("int"), F.lit(0)) <= 255
    )


def valid(kind: str, value: Column) -> Column:
    """The base rules of a kind."""
    n = F.length(digits(value))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _parts_fit(value)
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(value))).otherwise(False)
    return n.between(10, 15)


def _votes(kind: str, value: Column, before: Column) -> Column:
    """One letter per labeler: y, n or - for no opinion."""
    yes = lambda c: F.when(c, "y").otherwise("n")
    maybe = lambda c: F.when(c, "y").otherwise("-")
    n = F.length(digits(value))
    if kind in ("email", "mailat"):
        shape, known = yes(value.rlike(r"[A-Za-z]{2,24}$")), maybe(value.rlike(rf"(?i)(?:{ENDINGS})$"))
    elif kind == "ip":
        shape, known = yes(~value.rlike(r"(?:^|\.)0[0-9]")), F.when(value.rlike(r"^(?:0|127|255)\."), "n").otherwise("-")
    elif kind == "card":
        shape, known = yes(n.between(13, 19)), yes(value.rlike(r"^(?:4|5[1-5]|3[47]|6)"))
    elif kind == "phone":
        shape, known = yes(n.between(8, 15)), maybe(value.rlike(rf"^\+(?:{CALLING})"))
    elif kind == "local":
        shape, known = yes(n.between(9, 11)), F.lit("-")
    elif kind == "ssn":
        shape, known = yes(~value.rlike(r"^(?:000|666|9)|-00-|-0000$")), F.lit("-")
    else:
        shape, known = yes(F.length(F.regexp_replace(value, " ", "")).between(15, 34)), yes(value.rlike(f"^(?:{COUNTRIES})"))
    rule = yes(valid(kind, value)) if kind in BASE else F.lit("-")
    return F.concat(rule, shape, known, maybe(before.rlike(CUES)), F.when(before.rlike(AGAINST), "n").otherwise("-"))


def _features(value: Column, before: Column) -> list[Column]:
    """Features of a span, each of at most a dozen values."""
    size = F.length(value)
    return [
        F.concat(F.lit("l"), F.least(F.floor(size / 4), F.lit(10)).cast("string")),
        F.concat(F.lit("d"), F.floor(F.length(digits(value)) * 4 / F.greatest(size, F.lit(1))).cast("string")),
        F.when(before.rlike(r"[\x20\t\n]$") | (before == ""), "bb").when(before.rlike(r"[A-Za-z0-9]$"), "bw").otherwise("bp"),
        F.when(before.rlike(CUES), "cy").when(before.rlike(AGAINST), "cn").otherwise("c-"),
    ]


def candidates(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One narrow row per document: its candidate spans with votes and features, values left out."""
    text = F.col("text")
    pair = text.rlike(r"[0-9][\x20.-]?[0-9]")
    patterns = {
        "email": (BASE["email"], text.contains("@")), "ip": (BASE["ip"], pair & text.contains(".")), "card": (BASE["card"], pair),
        "phone": (BASE["phone"], text.contains("+")), "mailat": (MORE["mailat"], text.contains("at)") | text.contains("at]")),
        "local": (MORE["local"], pair), "ssn": (MORE["ssn"], pair & text.contains("-")), "iban": (MORE["iban"], pair),
    }
    read = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))
    seen = with_spans(read, "text", patterns).drop("text")
    # Numbers of a few digits are no candidates of anything.
    least = {"card": 12, "phone": 7}

    def judged(order: int, kind: str) -> Column:
        enough = F.filter(kind, lambda s: F.length(digits(s["value"])) >= least[kind]) if kind in least else F.col(kind)

        def row(s: Column) -> Column:
            base = valid(kind, s["value"]) if kind in BASE else F.lit(False)
            return F.struct(
                s["start"].alias("start"), F.lit(order).alias("order"), s["stop"].alias("stop"), F.lit(kind).alias("kind"),
                base.alias("base"), _votes(kind, s["value"], s["before"]).alias("votes"),
                F.array(*_features(s["value"], s["before"])).alias("features"),
            )

        return F.transform(enough, row)

    every = [judged(order, kind) for order, kind in enumerate(KINDS)]
    return seen.select("doc_id", F.array_sort(F.concat(*every)).alias("spans"))


def estimate(patterns: list[tuple[str, str, int]], rounds: int = ROUNDS) -> dict[tuple[str, str], float]:
    """Posterior of being personal data for each (kind, votes), by expectation-maximisation.

    Two classes, votes independent given the class; a labeler's rates are shared by all kinds, each
    kind has its share of the class. It starts from the majority of the votes.
    """
    known = {(k, v): (v.count("y") + 0.5) / (v.count("y") + v.count("n") + 1) for k, v, _ in patterns}
    for _ in range(rounds):
        share: dict = defaultdict(lambda: [1.0, 1.0])
        rate: dict = defaultdict(lambda: [1.0, 1.0])
        total: dict = defaultdict(lambda: [3.0, 3.0])
        for kind, votes, n in patterns:
            p = known[kind, votes]
            for c, weight in enumerate((n * (1 - p), n * p)):
                share[kind][c] += weight
                for labeler, vote in enumerate(votes):
                    rate[labeler, vote][c] += weight
                    total[labeler][c] += weight
        for kind, votes, _ in patterns:
            log = [math.log(share[kind][c] / sum(share[kind])) + sum(math.log(rate[j, v][c] / total[j][c]) for j, v in enumerate(votes)) for c in (0, 1)]
            known[kind, votes] = 1 / (1 + math.exp(max(-500.0, min(500.0, log[0] - log[1]))))
    return known


def train(counted: list[Row]) -> dict[str, float]:
    """Log odds of the naive Bayes classifier from counts of (kind, votes, features) and soft labels."""
    by_votes: dict = defaultdict(int)
    for r in counted:
        by_votes[r["kind"], r["votes"]] += r["n"]
    known = estimate([(k, v, n) for (k, v), n in sorted(by_votes.items())])
    weight: dict = defaultdict(lambda: [1.0, 1.0])
    whole = [1.0, 1.0]
    for r in counted:
        p = known[r["kind"], r["votes"]]
        for c, w in enumerate((r["n"] * (1 - p), r["n"] * p)):
            whole[c] += w
            for value in (r["kind"], *r["features"]):
                weight[value][c] += w
    odds = {value: math.log(w[1] / w[0]) - math.log(whole[1] / whole[0]) for value, w in weight.items()}
    return odds | {"": math.log(whole[1] / whole[0])}


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", accept: float = ACCEPT) -> DataFrame:
    """Base and learned spans of personal data in every document.

    Columns: ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans`` and
    ``marked``, the spans as an array. Base spans always stay; other candidates are added where the
    classifier gives at least ``accept``.

    A null text is empty and has no spans. Repeated rows are each returned; ids may be null. An empty
    table gives no rows; other columns are ignored. Texts of any length are scanned whole.
    """
    found = stored(candidates(docs, id_column, text_column), "pii")
    each = found.where(F.size("spans") > 0).select(F.explode("spans").alias("s"))
    # At most kinds x votes x features rows, however large the corpus.
    counted = each.groupBy(F.col("s.kind").alias("kind"), F.col("s.votes").alias("votes"), F.col("s.features").alias("features")).agg(F.count(F.lit(1)).alias("n"))
    odds = train(counted.collect())
    table = F.create_map(*[F.lit(x) for pair in sorted(odds.items()) for x in pair])
    weight = lambda value: F.coalesce(table[value], F.lit(0.0))
    least = math.log(accept / (1 - accept))

    def score(s: Column) -> Column:
        return F.aggregate(s["features"], F.lit(odds[""]) + weight(s["kind"]), lambda total, f: total + weight(f))

    base = F.filter("spans", lambda s: s["base"])
    marked = F.filter("spans", lambda s: s["base"] | (score(s) >= least))
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(kind) for kind in BASE], F.sha2(listed(base), 256).alias("base_sha256"),
        listed(marked).alias("spans"), F.transform(marked, lambda s: F.struct(s["start"], s["stop"], s["kind"])).alias("marked"),
    )
