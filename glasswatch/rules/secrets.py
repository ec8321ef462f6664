"""Secret rules: provider tokens by prefix, and assignments gated on entropy."""

from __future__ import annotations

from glasswatch.rules.model import Detector, ci, cs

_BOTH = ("prompt", "output")


def _token(name: str, patterns, hint: str) -> Detector:
    return Detector(f"secret-{name}", 39, patterns, stages=_BOTH, hint=hint)


SECRET_DETECTORS: tuple[Detector, ...] = (
    _token("github", cs(r"\bgh[pousr]_[A-Za-z0-9]{30,255}\b", r"\bgithub_pat_[A-Za-z0-9_]{22,255}\b"), "GitHub token."),
    _token("gitlab", cs(r"\bglpat-[A-Za-z0-9_-]{20,}"), "GitLab token."),
    _token("slack", cs(r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}", r"\bxapp-\d-[A-Za-z0-9-]{10,}"), "Slack token."),
    _token("stripe", cs(r"\b(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{10,}"), "Stripe key."),
    _token("aws", cs(r"\b(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}\b"), "AWS access key id."),
    _token("google", cs(r"\bAIza[A-Za-z0-9_-]{35}", r"\bya29\.[A-Za-z0-9_-]{20,}"), "Google API credential."),
    _token("anthropic", cs(r"\bsk-ant-[A-Za-z0-9_-]{16,}"), "Anthropic key."),
    _token("openai", cs(r"\bsk-(?:proj-|svcacct-)?[A-Za-z0-9_-]{20,}"), "OpenAI-style key."),
    _token("npm", cs(r"\bnpm_[A-Za-z0-9]{36}\b"), "npm token."),
    _token("pypi", cs(r"\bpypi-[A-Za-z0-9_-]{32,}"), "PyPI token."),
    _token("sendgrid", cs(r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"), "SendGrid key."),
    _token("twilio", cs(r"\b(?:AC|SK)[0-9a-f]{32}\b"), "Twilio id or key."),
    _token("huggingface", cs(r"\bhf_[A-Za-z0-9]{30,}\b"), "Hugging Face token."),
    _token("azure", cs(r"\bAccountKey=[A-Za-z0-9+\/=]{40,}"), "Azure storage key."),
    _token("telegram", cs(r"\b\d{8,10}:AA[A-Za-z0-9_-]{32,}"), "Telegram bot token."),
    _token("database-url",
           ci(r"\b(?:postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|redis|amqps?|mssql):\/\/[^\s:@\/]+:[^\s\/]+@[^\s\/]+"),
           "Connection string with a password."),
    Detector("secret-assignment", 39,
             ci(r"(?:api[_-]?key|secret|token|passwd|password|access[_-]?key|auth)[a-z0-9_]*[\"']?\s*[:=]\s*[\"'][^\s\"']{16,}[\"']"),
             stages=_BOTH, refine="strong_secret", hint="A high-entropy value is assigned to a secret name."),
)
