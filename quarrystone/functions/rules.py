"""Rule tables as data, and the columns that apply them in one projection."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Secrets, most specific first; the first rule that matches names the refusal.
SECRET_RULES = (
    ("private_key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("aws_access_key_id", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("slack_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b"),
    ("google_api_key", r"\bAIza[0-9A-Za-z_-]{35}\b"),
    ("openai_key", r"\bsk-[A-Za-z0-9]{32,}\b"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"),
    ("dsn_with_password", r"(?i)\b[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s/@]+@[^\s/]+"),
    ("authorization_header", r"(?i)\bauthorization\s*[:=]\s*[\"']?(?:bearer|basic)\s+\S+"),
    ("set_cookie", r"(?i)\bset-cookie\s*:\s*\S+"),
    (
        "assigned_credential",
        r"(?i)\b(?:password|passwd|secret|api[_-]?key|apikey|access[_-]?token|refresh[_-]?token|client[_-]?secret|private[_-]?key|credential)\b\s*[:=]\s*[\"']?[A-Za-z0-9/+_.=-]{8,}",
    ),
)
# Personal data in their order, with what stands in their place.
PII_RULES = (
    ("email", r"\b[\w.+-]+@[\w-]+\.[\w.-]{2,}\b", "[EMAIL]"),
    ("cpf", r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", "[CPF]"),
    ("cnpj", r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b", "[CNPJ]"),
    ("credit_card", r"\b(?:\d[ -]?){13,19}\b", "[CARD]"),
    ("phone", r"(?<![\w.])(?:\+55\s?)?\(?\d{2}\)?\s?9?\d{4}[-\s]?\d{4}(?!\d)(?!\.\d)", "[PHONE]"),
)
# Attempts to give instructions; all that match are named, in this order.
INSTRUCTION_RULES = (
    ("override_prior_instructions", r"(?i)\b(?:ignore|disregard|forget|override)\b[^.\n]{0,40}\b(?:previous|prior|above|earlier|all)\b[^.\n]{0,20}\b(?:instruction|prompt|rule|direction)"),
    (
        "override_prior_instructions_pt",
        r"(?i)\b(?:ignore|desconsidere|esque[cç]a)\b[^.\n]{0,40}(?:\b(?:anterior|anteriores|acima|todas)\b[^.\n]{0,20}\b(?:instru|prompt|regra)|\b(?:instru\w*|prompt\w*|regra\w*)\b[^.\n]{0,20}\b(?:anterior|acima))",
    ),
    ("role_reassignment", r"(?i)\byou\s+are\s+now\b|\bact\s+as\s+(?:a\s+)?(?:system|admin|developer)\b|\bvoc[êe]\s+agora\s+[ée]\b"),
    ("fake_turn_marker", r"(?im)^\s*(?:system|assistant|user)\s*:\s*\S|<\|im_(?:start|end)\|>|<\s*/?\s*(?:system|assistant)\s*>"),
    ("tool_or_exfiltration_request", r"(?i)\b(?:run|execute|curl|wget|send)\b[^.\n]{0,40}\b(?:command|shell|script|this\s+url|to\s+https?://)|\bexfiltrat|\bpost\s+the\s+(?:contents|secret|key|token)"),
    ("authority_claim", r"(?i)\b(?:this|these)\s+(?:instruction|rule|directive)s?\s+(?:override|supersede|take\s+precedence)"),
)
# What a text that a rule matches holds, one of each group at least; groups with False in front are looked for whatever their case.
ANCHORS = {
    "private_key_block": ((True, "PRIVATE KEY-----"),), "aws_access_key_id": ((True, "AKIA", "ASIA"),), "github_token": ((True, "_"), (True, "gh")), "slack_token": ((True, "xox"),),
    "google_api_key": ((True, "AIza"),), "openai_key": ((True, "sk-"),), "jwt": ((True, "eyJ"),), "dsn_with_password": ((True, "://"), (True, "@")), "authorization_header": ((True, ":", "="), (False, "authorization")),
    "set_cookie": ((True, ":"), (False, "set-cookie")), "assigned_credential": ((True, ":", "="), (False, "passw", "secret", "key", "token", "credential")),
}
#: A text that any of PII_RULES matches has an @ or two digits, with a space or a hyphen between them at most.
_MAYBE_PII = r"@|[0-9][ -]?[0-9]"
CLASSES = ("PUBLIC", "INTERNAL", "CLIENT_CONFIDENTIAL", "PII")


def _matches(text: Column, name: str, pattern: str) -> Column:
    """Does a rule match? Plain strings that a match cannot lack are looked for first, as that costs a fraction of a pattern."""
    found = F.lit(True)
    for cased, *parts in ANCHORS[name] if (name, pattern) in SECRET_RULES else ():
        found = found & reduce(or_, [F.contains(text if cased else F.lower(text), F.lit(x)) for x in parts])
    return found & text.rlike(pattern)


def first_secret(text: Column, rules: tuple = SECRET_RULES) -> Column:
    """The name of the first rule that matches, or null."""
    return F.coalesce(*[F.when(_matches(text, name, pattern), F.lit(name)) for name, pattern in rules])


def all_attempts(text: Column, rules: tuple = INSTRUCTION_RULES) -> Column:
    """The names of all rules that match, in rule order."""
    return F.filter(F.array(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in rules]), lambda n: n.isNotNull())


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for a row, however often use names it."""
    return F.transform(F.array(value), use)[0]


def _cards_out(text: Column, pattern: str, new: str) -> Column:
    """text, which must be cheap to name, without the numbers that pass the check digit; longer ones first, so that none is replaced inside another."""
    found = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), lambda m: F.call_function("luhn_check", F.regexp_replace(m, r"\D", "")))
    order = F.array_sort(F.transform(found, lambda m: F.struct((-F.length(m)).alias("n"), m.alias("m"))))
    return F.aggregate(order, text, lambda t, x: F.replace(t, x["m"], F.lit(new)))


def minimised(text: Column, declared: str = "INTERNAL", rules: tuple = PII_RULES) -> Column:
    """struct<text, redactions, data_class>: personal data replaced, the rules that changed something, the widened class.

    Each rule reads the text that the rule before has left, once; texts that none of PII_RULES can match are told apart first.
    """
    wider = CLASSES.index(declared) < CLASSES.index("PII")

    def after(rest: tuple, clean: Column, redactions: Column) -> Column:
        if not rest:
            return F.struct(clean.alias("text"), redactions.alias("redactions"), F.when((F.size(redactions) > 0) & F.lit(wider), "PII").otherwise(declared).alias("data_class"))
        (name, pattern, new), *others = rest

        def told(state: Column) -> Column:
            return after(tuple(others), state["text"], state["redactions"])

        def changed(new_text: Column) -> Column:
            return F.struct(new_text.alias("text"), F.when(new_text != clean, F.array_append(redactions, F.lit(name))).otherwise(redactions).alias("redactions"))

        return once(once(_cards_out(clean, pattern, new) if name == "credit_card" else F.regexp_replace(clean, pattern, new), changed), told)

    none = F.array().cast("array<string>")
    full = once(F.struct(text.alias("text"), none.alias("redactions")), lambda s: after(tuple(rules), s["text"], s["redactions"]))
    return F.when(text.rlike(_MAYBE_PII), full).otherwise(F.struct(text.alias("text"), none.alias("redactions"), F.lit(declared).alias("data_class"))) if set(rules) <= set(PII_RULES) else full
