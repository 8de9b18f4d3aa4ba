"""Personal data by candidate gradient boosting, with DataFrame functions only.

Base kinds (email, ip, card, phone) are patterns with checks; their spans always
stay. High-recall generators propose further, overlapping spans; boosted trees score
each from its format and its context; a threshold for each kind, calibrated for
precision on examples the trees have not seen, selects spans.

The trees are fitted when first used, on a bounded set of labelled examples made from
rules (N_EXAMPLES for each of two folds); the same SQL expressions give the features of examples and of
candidates, and the fitted trees are a SQL expression themselves.

Spans are code points, end exclusive. Defined results: a null text is an empty one;
repeated rows and further columns are harmless; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_rows, fields
from .native import let, prefix_sums

#: The base patterns, each equal to its plain form but without its repeated attempts inside a run.
_MAIL_START = "(?:\\G|(?<![A-Za-z0-9._%+-]))"
BASE = {
    "email": _MAIL_START + "[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[ -]?[0-9])++",
    "phone": "\\+[0-9][ ().0-9-]+[0-9]",
}
#: Generators: high recall, low precision; each kind's trees decide. Lengths are those of the formats (RFC 5321 for mail); secrets have none.
PROPOSALS = {
    "x_email": "[A-Za-z0-9._%+-]{1,64} ?(?:@|\\(at\\)|\\[at\\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\\.|\\(dot\\)|\\[dot\\]) ?[A-Za-z0-9-]{2,63}){1,6}",
    "x_iban": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8}(?![A-Za-z0-9])",
    "x_number": "(?<![0-9A-Za-z.])[(0-9](?:[ ()./-]?[0-9]){5,22}(?![0-9A-Za-z])",
    "x_secret": "(?<![A-Za-z0-9+/_-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_-])",
}
KINDS = (*BASE, *PROPOSALS)
N_EXAMPLES = 900
CONTEXT = 24
#: Features, all numbers: format first, context after.
FEATURES = {
    "length": "cast(length(s) as double)",
    "digits": "cast(length(regexp_replace(s, '[^0-9]+', '')) as double)",
    "digit_share": "length(regexp_replace(s, '[^0-9]+', '')) / greatest(length(s), 1)",
    "upper_share": "length(regexp_replace(s, '[^A-Z]+', '')) / greatest(length(s), 1)",
    "hex_share": "length(regexp_replace(s, '[^0-9a-f]+', '')) / greatest(length(s), 1)",
    "marks": "cast(length(regexp_replace(s, '[A-Za-z0-9]+', '')) as double)",
    "switches": "cast(length(regexp_replace(regexp_replace(regexp_replace(s, '[A-Za-z]+', 'a'), '[0-9]+', '9'), '[^a9]+', '')) as double)",
    "groups": "cast(length(regexp_replace(regexp_replace(s, '[0-9]+', '9'), '[^9]+', '')) as double)",
    "distinct": "cast(size(array_distinct(split(lower(s), ''))) as double)",
    "luhn": "if(luhn_check(regexp_replace(s, '[^0-9]+', '')), 1D, 0D)",
    "dated": "if(s rlike '^(19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}$|^[0-9]{1,2}[-/.][0-9]{1,2}[-/.](19|20)[0-9]{2}$', 1D, 0D)",
    "phone_word": "if(lower(before) rlike '(tel|phone|call|fax|mobile|sms)[^a-z]*$', 1D, 0D)",
    "secret_word": "if(lower(before) rlike '(key|token|secret|passw|pwd|auth|bearer)[a-z]*[^a-z0-9]*$', 1D, 0D)",
    "id_word": "if(lower(before) rlike '(ssn|iban|account|passport|social|card)[a-z]*[^a-z0-9]*$', 1D, 0D)",
    "harmless_word": "if(lower(before) rlike '(version|order|invoice|isbn|page|price|item|build|ticket|figure|lot|ref)[a-z]*[^a-z0-9]*$', 1D, 0D)",
    "assigned": "if(before rlike '[=:][ \"]*$', 1D, 0D)",
    "quoted": "if(before rlike '[\"]$' and after rlike '^[\"]', 1D, 0D)",
}


def _starts(matches: Column, gaps: Column) -> Column:
    """Where each match begins: all gaps up to it and all matches before it."""
    lengths = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    both = F.filter(lengths, lambda x: x["m"].isNotNull())
    before = prefix_sums(F.transform(both, lambda x: (x["g"] + x["m"]).cast("long")))
    return F.zip_with(before, both, lambda b, x: b + x["g"])


def _spans(text: Column, kind: str, pattern: str, check) -> Column:
    """array<struct<kind, start, end, s>> of the leftmost non-overlapping matches that pass the check."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(m: Column) -> Column:
        at = F.zip_with(_starts(m, gaps), m, lambda b, s: F.struct(F.lit(kind).alias("kind"), b.alias("start"), (b + F.length(s)).alias("end"), s.alias("s")))
        return F.filter(at, lambda x: check(x["s"]))

    return let(matches, lambda m: F.when(F.size(m) == 0, F.array().cast(_SPANS)).otherwise(placed(m)))


_SPANS = "array<struct<kind:string,start:bigint,end:bigint,s:string>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]+", "")


CHECKS = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: F.forall(F.split(s, "\\.", -1), lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda q: (F.length(q) <= 3) & (F.coalesce(q.try_cast("int"), F.lit(999)) <= 255))),
    "card": lambda s: let(_digits(s), lambda d: F.length(d).between(16, 19) & F.call_function("luhn_check", d)),
    "phone": lambda s: F.length(_digits(s)).between(8, 15),
}


def base_spans(text: Column) -> Column:
    """The base spans of a text, kinds in their order, then by start."""
    numbers = text.rlike("[0-9]")
    needed = {"email": F.contains(text, F.lit("@")), "ip": numbers & F.contains(text, F.lit(".")), "card": numbers, "phone": numbers & F.contains(text, F.lit("+"))}
    return F.concat(*[F.when(needed[k], _spans(text, k, BASE[k], CHECKS[k])).otherwise(F.array().cast(_SPANS)) for k in BASE])


def candidates(text: Column) -> Column:
    """What the generators propose, with the text around it: array<struct<kind, start, end, s, before, after>>."""
    numbers = text.rlike("[0-9]")
    gate = {"x_email": text.rlike("@|\\(at\\)|\\[at\\]"), "x_iban": text.rlike("[A-Z]{2}[0-9]{2}"), "x_number": text.rlike("[0-9](?:[^0-9]?[^0-9]?[0-9]){5}"), "x_secret": numbers}
    found = F.concat(*[F.when(gate[k], _spans(text, k, p, lambda s: F.lit(True))).otherwise(F.array().cast(_SPANS)) for k, p in PROPOSALS.items()])

    def around(x: Column) -> Column:
        first = F.greatest(x["start"] - CONTEXT, F.lit(0))
        return F.struct(
            x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"),
            F.substring(text, (first + 1).cast("int"), (x["start"] - first).cast("int")).alias("before"),
            F.substring(text, (x["end"] + 1).cast("int"), F.lit(CONTEXT)).alias("after"),
        )

    return F.transform(found, around)


def examples(seed: int, n: int = N_EXAMPLES) -> list[dict]:
    """Labelled candidates with context, made from rules: every generator's kind gets as many of either label."""
    r = random.Random(seed)
    pick, digits = r.choice, lambda k: "".join(r.choice("0123456789") for _ in range(k))
    letters = lambda k, of="abcdefghijklmnopqrstuvwxyz": "".join(r.choice(of) for _ in range(k))
    words = lambda: " ".join(letters(r.randint(2, 8)) for _ in range(r.randint(1, 3)))

    def luhn(body: str) -> str:
        total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    def card() -> str:
        d = luhn(digits(r.randint(14, 15)))
        return pick((d, " ".join(d[i : i + 4] for i in range(0, len(d), 4)), "-".join(d[i : i + 4] for i in range(0, len(d), 4))))

    def iban() -> str:
        d = letters(2, "ABDEFINST") + digits(r.randint(16, 22))
        return pick((d, " ".join(d[i : i + 4] for i in range(0, len(d), 4))))

    mail = lambda: f"{letters(5)}{pick(('', '.', digits(2)))}{letters(3)}"
    site = lambda: f"{letters(6)}{pick((' (dot) ', '[dot]', '.'))}{pick(('com', 'org', 'net', 'de'))}"
    yes = {
        "x_email": lambda: (f"{mail()}{pick((' (at) ', '[at]', ' @ ', '@'))}{site()}", words()),
        "x_iban": lambda: (iban(), pick(("IBAN ", "account: ", words() + " "))),
        "x_number": lambda: pick(((f"{digits(3)}-{digits(2)}-{digits(4)}", pick(("SSN ", "ssn: ", words() + " "))), (f"({digits(3)}) {digits(3)}-{digits(4)}", pick(("call ", "tel. ", words() + " "))), (f"{digits(3)}-{digits(3)}-{digits(4)}", pick(("phone ", "mobile: ", words() + " "))), (card(), pick(("card ", words() + " "))), (digits(10), pick(("phone: ", "call ", "tel "))))),
        "x_secret": lambda: pick(((letters(r.choice((32, 40, 64)), "0123456789abcdef"), pick(('token = "', "key=", "secret: ", words() + " "))), ("AKIA" + letters(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), words() + " "), (letters(24, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), pick(("password=", "api_key: ", "Bearer "))), (letters(18, "0123456789abcdef"), "password="))),
    }
    no = {
        "x_email": lambda: (f"{letters(4)} @ {letters(5)}. {letters(4)}", words()),
        "x_iban": lambda: (f"{letters(2, 'ABCXYZ')}{digits(2)} {letters(3, 'ABCDEFGH')} {letters(4, 'ABCDEFGH')} {letters(3, 'ABCDEFGH')}", pick(("item ", words() + " "))),
        "x_number": lambda: pick(((f"20{digits(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", words() + " "), (f"{r.randint(1, 28)}/{r.randint(1, 12)}/19{digits(2)}", words() + " "), (digits(r.randint(6, 9)), pick(("order ", "invoice ", "item ", words() + " "))), (f"{digits(3)} {digits(3)} {digits(3)}", words() + " "), (f"{digits(2)}.{digits(3)}.{digits(3)}", pick(("price ", "version "))), (digits(13), pick(("isbn ", "order ", "ref "))))),
        "x_secret": lambda: pick(((f"{letters(8)}-{letters(6)}-{digits(4)}", words() + " "), (f"{letters(6)}/{letters(7)}/{digits(4)}", words() + " "), (letters(14) + digits(2), words() + " "), (f"{letters(5)}_{letters(9)}_{digits(2)}", words() + " "), (f"{letters(10, 'ABCDEFGHIJ')}-{digits(6)}", "ticket "))),
    }
    out = []
    for k in range(n):
        for kind in PROPOSALS:
            made, label = (yes, 1) if k % 2 else (no, 0)
            s, before = made[kind]()
            out.append({"kind": kind, "s": s, "before": before, "after": pick((" " + words(), ". ", "\n", '"')) if not before.endswith('"') else '"', "label": label})
    return out


class Boosted:
    """Depth-two regression trees on logistic loss, fitted by exact search over quantile cuts of bounded data."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 24, rate: float = 0.4) -> None:
        self.bias = 0.0
        self.trees: list[tuple] = []
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.05, 0.95, 19), method="nearest")) for j in range(x.shape[1])]
        f = np.zeros(len(y))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            root = self._split(x, g, h, np.ones(len(y), bool), cuts)
            if root is None:
                break
            j, c = root
            left = x[:, j] <= c
            leaves = []
            for part in (left, ~left):
                below = self._split(x, g, h, part, cuts)
                masks = [part] if below is None else [part & (x[:, below[0]] <= below[1]), part & (x[:, below[0]] > below[1])]
                values = [float(rate * g[m].sum() / (h[m].sum() + 1.0)) for m in masks]
                for m, v in zip(masks, values, strict=True):
                    f[m] += v
                leaves.append((below, values))
            self.trees.append((j, float(c), leaves))

    @staticmethod
    def _split(x, g, h, part, cuts):
        best, found = 1e-6, None
        total = g[part].sum() ** 2 / (h[part].sum() + 1.0)
        for j, values in enumerate(cuts):
            for c in values:
                m = part & (x[:, j] <= c)
                n = part & ~(x[:, j] <= c)
                if m.any() and n.any():
                    gain = g[m].sum() ** 2 / (h[m].sum() + 1.0) + g[n].sum() ** 2 / (h[n].sum() + 1.0) - total
                    if gain > best:
                        best, found = gain, (j, c)
        return found

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for j, c, leaves in self.trees:
            for side, (below, values) in zip((x[:, j] <= c, x[:, j] > c), leaves, strict=True):
                out += np.where(side, values[0] if below is None else np.where(x[:, below[0]] <= below[1], values[0], values[1]), 0.0)
        return out

    def sql(self, names: list[str]) -> str:
        def leaf(below, values) -> str:
            return f"{values[0]!r}D" if below is None else f"if({names[below[0]]} <= {float(below[1])!r}D, {values[0]!r}D, {values[1]!r}D)"

        return " + ".join(f"if({names[j]} <= {c!r}D, {leaf(*a)}, {leaf(*b)})" for j, c, (a, b) in self.trees) or "0D"


@functools.cache
def _fitted(precision: float = 0.98) -> dict[str, tuple[str, float]]:
    """kind -> (SQL of the trees' sum, threshold)."""
    spark = SparkSession.getActiveSession()
    schema = "array<struct<kind:string,s:string,before:string,after:string,label:int,fold:int>>"
    made = [x | {"fold": k} for k in (0, 1) for x in examples(k + 1)]
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(made)), schema)).alias("x")).select("x.*")
    got = rows.selectExpr("kind", "label", "fold", *[f"{e} as f_{n}" for n, e in FEATURES.items()]).collect()
    out = {}
    for kind in PROPOSALS:
        x, y, fold = (np.array(v) for v in zip(*[([float(r[f"f_{n}"]) for n in FEATURES], r["label"], r["fold"]) for r in got if r["kind"] == kind], strict=True))
        trees = Boosted(x[fold == 0], y[fold == 0])
        scores, truth = trees.score(x[fold == 1]), y[fold == 1]
        order = np.argsort(-scores, kind="stable")
        share = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(share >= precision)
        out[kind] = (trees.sql([f"x.f_{n}" for n in FEATURES]), max(0.0, float(scores[order][good[-1]])) if len(good) else float("inf"))
    return out


def _selected(found: str) -> Column:
    """The candidates in column found that the trees accept, as spans."""
    fitted = _fitted()
    features = ", ".join(f"{_on(e)} as f_{n}" for n, e in FEATURES.items())
    with_features = f"transform({found}, c -> struct(c.kind, c.start, c.end, c.s, {features}))"
    accepted = " or ".join(f"x.kind = '{k}' and ({sql}) >= {bar!r}D" for k, (sql, bar) in fitted.items() if bar != float("inf")) or "false"
    return F.expr(f"transform(filter({with_features}, x -> {accepted}), x -> struct(x.kind as kind, x.start as start, x.end as end, x.s as s))")


def _on(expression: str) -> str:
    """A feature's expression over the fields of the lambda's c."""
    return re.sub(r"\b(s|before|after)\b(?!['\w])", r"c.\1", expression)


def spans(docs: DataFrame) -> DataFrame:
    """docs with base (array of base spans) and added (array of the method's spans that no base span covers) added (or replaced)."""
    docs = docs.drop("base", "added")
    return _with_spans(docs).select(*fields(docs), "base", "added")


def _with_spans(docs: DataFrame) -> DataFrame:
    """docs as row, with text, base and added."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = as_rows(docs, text=F.col("text")).withColumns({"base": base_spans(text), "found": F.when(text.rlike("[0-9@]|\\(at\\)|\\[at\\]"), candidates(text))})
    added = F.coalesce(F.when(F.size("found") > 0, _selected("found")), F.array().cast(_SPANS))
    rows = rows.withColumn("added", added)
    covered = lambda x: F.exists("base", lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"]))
    return rows.withColumn("added", F.filter("added", lambda x: ~covered(x))).drop("found")


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row."""
    rows = spans(docs.select(F.col("doc_id").cast("long"), "text"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(number, BASE), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; overlapping spans become one, named by the first."""
    rows = _with_spans(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    order = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), F.upper(F.regexp_replace(x["kind"], "^x_", "")).alias("kind"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        plain = F.substring(text, (state["at"] + 1).cast("int"), (x["start"] - state["at"]).cast("int"))
        new = F.struct((-x["back"]).alias("at"), F.concat(state["out"], F.array(F.concat(plain, F.lit("["), x["kind"], F.lit("]")))).alias("out"))
        longer = F.struct(F.greatest(state["at"], -x["back"]).alias("at"), state["out"].alias("out"))
        return F.when(x["start"] >= state["at"], new).otherwise(longer)

    whole = F.aggregate(order, start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    changed = F.size("base") + F.size("added") > 0
    return rows.select(*fields(docs, text=F.when(changed, whole).otherwise(F.col("text"))))
