"""Weighted detectors: several signals add up to a confidence."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

from glasswatch.functions.regex_dialect import Pattern

RULE_VERSION = "detector-v1"
DEFAULT_FIRE = Decimal("0.75")
DEFAULT_ESCALATE = Decimal("0.40")
P, C, F, A, T, X = ("prompt.submit", "content.paste", "file.upload", "ai.response", "tool.open", "session.context")


@dataclass(frozen=True)
class Signal:
    kind: str                     # regex, keyword, phrase, entity, code, url, allowlist, heuristic
    weight: Decimal
    patterns: tuple[Pattern, ...] = ()
    name: str = ""                # entity / code / url / allowlist / heuristic kind
    scope: str = "text"           # text or filename


@dataclass(frozen=True)
class WeightedDetector:
    detector_id: str
    threat_id: int
    applies_to: tuple[str, ...]
    signals: tuple[Signal, ...]
    combine: str = "weighted_sum"
    fire: Decimal = DEFAULT_FIRE
    escalate: Decimal = DEFAULT_ESCALATE


def regex(weight, source, scope="text"):
    flags = ""
    if source.startswith("(?i)"):
        source, flags = source[4:], "i"
    return Signal("regex", Decimal(weight), (Pattern(source, flags),), scope=scope)


def keyword(weight, *terms, scope="text"):
    return Signal("keyword", Decimal(weight), tuple(Pattern(re.escape(t), "i") for t in terms), scope=scope)


def phrase(weight, *sources):
    return Signal("phrase", Decimal(weight), tuple(Pattern(s, "i") for s in sources))


def kind(signal, weight, name, scope="text"):
    return Signal(signal, Decimal(weight), name=name, scope=scope)


def _d(detector_id, threat_id, applies_to, *signals, combine="weighted_sum", fire="0.75", escalate="0.40"):
    return WeightedDetector(detector_id, threat_id, applies_to, signals, combine, Decimal(fire), Decimal(escalate))


_IBAN = r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"

# Ids, threat numbers, events, weights, terms and thresholds are fixed values.
WEIGHTED: tuple[WeightedDetector, ...] = (
    _d("dlp.entity.credit_card", 1, (P, C, F), kind("entity", "0.80", "CREDIT_CARD"),
       regex("0.40", r"\b(?:\d[ -]*?){13,16}\b"), fire="0.70"),
    _d("dlp.entity.iban", 1, (P, C, F), regex("0.80", _IBAN), combine="any", fire="0.70"),
    _d("dlp.entity.national_id", 15, (P, C, F), regex("0.45", r"\b\d{9}\b"),
       keyword("0.45", "id number", "national id", "passport", "ssn", "social security", 'ת"ז', "תעודת זהות")),
    _d("dlp.secret.api_key", 1, (P, C, F),
       regex("0.85", r"(sk-[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]+)"),
       keyword("0.30", "api key", "secret key", "access token", "bearer", "private key", "client_secret"), fire="0.70"),
    _d("dlp.pii.hr_sensitive", 15, (P, C, F), kind("entity", "0.20", "EMAIL"), kind("entity", "0.20", "PHONE"),
       keyword("0.60", "salary", "compensation", "termination", "medical", "diagnosis", "performance review",
               "disciplinary", "resume", "cv"), escalate="0.45"),
    _d("ip.source_or_strategy", 9, (P, C, F), kind("code", "0.45", "ANY_SOURCE"),
       keyword("0.50", "roadmap", "architecture", "proprietary", "confidential", "internal only", "price quote",
               "go-to-market", "trade secret"), escalate="0.45"),
    _d("promptleak.internal_instructions", 39, (P, C),
       phrase("0.60", "you are an? .* assistant", "system prompt", "internal use only", "do not share externally", "company policy:"),
       keyword("0.30", "template", "system instructions", "internal prompt"), escalate="0.45"),
    _d("injection.direct", 2, (P, C),
       phrase("0.70", "ignore (the |all |previous |above )?(instructions|prompt|rules)",
              "disregard (the|your) (instructions|guidelines|rules)", "reveal your (system )?prompt", "you are now",
              "pretend you are", "developer mode"), combine="any", fire="0.70"),
    _d("injection.indirect", 3, (A, F, C),
       phrase("0.70", "ignore (the |previous |above )?(instructions|guidelines)",
              "send (the|this|all) (data|information|file) to", "forward this to", "exfiltrate", "do not tell the user"),
       combine="any", fire="0.60", escalate="0.35"),
    _d("injection.second_order", 40, (A, C), keyword("0.35", "ticket", "support form", "service request", "case note"),
       phrase("0.45", "perform the following action", "execute", "approve and", "automatically"), fire="0.80", escalate="0.45"),
    _d("output.dangerous_code", 32, (A,),
       regex("0.80", r"(?i)(invoke-webrequest|iex\s*\(|curl\s+[^|]+\|\s*(ba)?sh|wget\s+[^|]+\|\s*sh|Set-ExecutionPolicy|rm\s+-rf\s+/|Auto_?Open|Workbook_Open|CreateObject\(\"WScript)"),
       kind("code", "0.40", "POWERSHELL_OR_MACRO"), fire="0.70"),
    _d("output.suspicious_link", 17, (A,), kind("url", "0.50", "SHORTENER"), kind("url", "0.60", "DISPLAY_HREF_MISMATCH"),
       fire="0.60", escalate="0.35"),
    _d("output.fabricated_source", 29, (A,),
       regex("0.40", r"(?i)(et al\.|doi:|ISBN|\bv\.\s|\bU\.S\.\s|section\s+\d+|article\s+\d+)"),
       kind("url", "0.50", "UNRESOLVABLE"), fire="0.80"),
    _d("socialeng.bank_detail_change", 30, (P, C, A, F), regex("0.40", _IBAN),
       keyword("0.30", "account number", "routing number", "swift", "wire"),
       phrase("0.50", "changed our bank", "new bank details", "updated banking", "new account", "remittance to"),
       fire="0.80", escalate="0.45"),
    _d("socialeng.bec_urgency", 11, (C, F),
       phrase("0.50", "urgent (payment|wire|transfer)", "as soon as possible", "keep this confidential",
              "are you at your desk", "need this done before"),
       keyword("0.35", "ceo", "cfo", "invoice", "gift card", "wire transfer"), fire="0.80", escalate="0.45"),
    _d("shadow.unapproved_tool", 7, (T,), kind("allowlist", "1.00", "AI_TOOL"), combine="any", fire="0.50", escalate="0.00"),
    _d("upload.sensitive_file", 27, (F,),
       keyword("0.40", "contract", "nda", "confidential", "salary", "passport", "agreement", "invoice", scope="filename"),
       kind("entity", "0.50", "ANY_PII"), escalate="0.45"),
    _d("context.customer_mixing", 36, (P, X), kind("heuristic", "0.80", "FOREIGN_CONTEXT_TAG"), combine="any",
       fire="0.80", escalate="0.50"),
)

EVENT_TYPES = (P, C, F, A, T, X)

# This project's own definitions of the named kinds.
ENTITY_PATTERNS: dict[str, tuple[Pattern, ...]] = {
    "EMAIL": (Pattern(r"\b[\w.+-]+@[\w-]+\.[\w.-]{2,}\b"),),
    "PHONE": (Pattern(r"(?<!\d)(?:\+?\d{1,3}[ .-]?)?\(?\d{2,4}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)"),),
    "NATIONAL_ID": (Pattern(r"(?<!\d)\d{9}(?!\d)"),),
    "IBAN": (Pattern(_IBAN),),
    "CREDIT_CARD": (Pattern(r"\b(?:\d[ -]?){13,16}\b"),),   # and a valid check digit
}
CODE_PATTERNS: dict[str, tuple[Pattern, ...]] = {
    "ANY_SOURCE": (Pattern(r"(^|\n)\s*(def|class|import|from|function|package|using|namespace)\s+\w+", ""),
                   Pattern(r"#include\s*[<\"]"), Pattern(r"\b(public|private)\s+(static\s+)?\w+\s+\w+\s*\("), Pattern(r"```")),
    "POWERSHELL_OR_MACRO": (Pattern(r"\b(powershell|invoke-expression|sub\s+auto_?open|vba|macro)\b", "i"),),
}
SHORTENER_HOSTS = ("bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "rebrand.ly", "cutt.ly", "t.ly")
