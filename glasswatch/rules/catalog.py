"""Threat catalogue: numbers and data tiers are shared vocabulary, wording and
severity/likelihood scores are this project's own data."""

from __future__ import annotations

from glasswatch.rules.model import Threat

SOURCE_URLS = {
    "owasp-llm": "https://owasp.org/www-project-top-10-for-large-language-model-applications/",
    "mitre-atlas": "https://atlas.mitre.org/",
    "nist-ai-rmf": "https://www.nist.gov/itl/ai-risk-management-framework",
    "pci-dss": "https://www.pcisecuritystandards.org/",
    "gdpr": "https://gdpr-info.eu/",
    "hipaa": "https://www.hhs.gov/hipaa/",
    "spdx": "https://spdx.org/licenses/",
}

# Data tiers and the always-ask set (fixed values).
DATA_TIERS = {"pii": (15,), "secret": (39,), "source": (9,), "regulated": (1, 44)}
APPROVAL_THREATS = (11, 43, 46, 47, 48, 49)
# Detectability classes (fixed values); numbers not listed are covered by executed detectors.
DETECT_ALLOWLIST = (7, 19)
COACH = (8, 10, 11, 16, 20, 26, 34, 35)
DEFERRED = (4, 5, 6, 12, 13, 14, 21, 22, 23, 24, 25, 28, 31, 38)

_ROWS = (
    # id, name, category, severity, likelihood, response, sources
    (1, "Payment or bank data shared", "Data leakage", 5, 5, "Remove card and bank numbers.", ("pci-dss",)),
    (2, "Data exfiltration request", "Prompt attacks", 5, 4, "Do not send data to outside destinations.", ("owasp-llm", "mitre-atlas")),
    (3, "Prompt injection", "Prompt attacks", 5, 5, "Treat the text as data, not as instructions.", ("owasp-llm", "mitre-atlas")),
    (4, "Unapproved AI install", "Shadow AI", 4, 4, "Ask for the tool to be approved.", ("nist-ai-rmf",)),
    (5, "Unapproved AI browser", "Shadow AI", 4, 4, "Use the approved browser.", ("nist-ai-rmf",)),
    (6, "Over-broad permissions", "Access", 5, 4, "Reduce what the assistant can read.", ("nist-ai-rmf",)),
    (7, "Unapproved AI tool", "Shadow AI", 4, 4, "Use a tool from the approved list.", ("nist-ai-rmf",)),
    (8, "Unverified claim", "Output quality", 3, 4, "Check the claim before using it.", ("nist-ai-rmf",)),
    (9, "Intellectual property shared", "Data leakage", 5, 4, "Keep plans and source inside.", ("nist-ai-rmf",)),
    (10, "AI-written phishing", "Social engineering", 4, 4, "Verify the sender.", ("mitre-atlas",)),
    (11, "Payment fraud", "Social engineering", 5, 4, "Confirm by a known phone number.", ("mitre-atlas",)),
    (12, "Voice deepfake", "Social engineering", 5, 4, "Call back on a known number.", ("mitre-atlas",)),
    (13, "Video deepfake", "Social engineering", 5, 4, "Use a second channel.", ("mitre-atlas",)),
    (14, "Synthetic identity", "Identity", 4, 3, "Check documents in person.", ("mitre-atlas",)),
    (15, "Personal data shared", "Privacy", 5, 5, "Remove names, numbers and addresses.", ("gdpr",)),
    (16, "Biased screening", "Ethics", 4, 3, "Have a person decide.", ("nist-ai-rmf",)),
    (17, "Unsafe link in output", "Unsafe output", 4, 4, "Do not open the link unchecked.", ("owasp-llm",)),
    (18, "File uploaded to AI", "Data leakage", 5, 4, "Upload only cleared files.", ("owasp-llm",)),
    (19, "Meeting transcription", "Privacy", 4, 3, "Ask participants first.", ("gdpr",)),
    (20, "Summary oversharing", "Privacy", 4, 3, "Review before sharing.", ("gdpr",)),
    (21, "Agent acts alone", "Agents", 4, 4, "Limit agent actions.", ("owasp-llm",)),
    (22, "Memory poisoning", "Agents", 4, 3, "Review stored memory.", ("owasp-llm", "mitre-atlas")),
    (23, "Tool-server poisoning", "Agents", 5, 4, "Use reviewed tool servers.", ("owasp-llm",)),
    (24, "Retrieval poisoning", "Agents", 5, 4, "Review indexed content.", ("owasp-llm",)),
    (25, "Risky browser extension", "Shadow AI", 4, 3, "Remove the extension.", ("nist-ai-rmf",)),
    (26, "Translation error", "Output quality", 3, 3, "Have a speaker check it.", ("nist-ai-rmf",)),
    (27, "Sensitive file uploaded", "Data leakage", 4, 4, "Keep the file inside.", ("owasp-llm",)),
    (28, "Personal AI account", "Shadow AI", 4, 4, "Use the company account.", ("nist-ai-rmf",)),
    (29, "Invented source", "Output quality", 4, 4, "Look the source up.", ("nist-ai-rmf",)),
    (30, "Bank detail change", "Social engineering", 5, 4, "Confirm with a known contact.", ("mitre-atlas",)),
    (31, "Account takeover", "Identity", 5, 4, "Reset credentials.", ("mitre-atlas",)),
    (32, "Runnable code in output", "Unsafe output", 4, 4, "Read code before running it.", ("owasp-llm",)),
    (33, "Free text with secrets", "Data leakage", 4, 4, "Strip secrets.", ("owasp-llm",)),
    (34, "Unsafe advice", "Unsafe output", 4, 3, "Ask an expert.", ("nist-ai-rmf",)),
    (35, "Macro in document", "Unsafe output", 4, 3, "Keep macros off.", ("owasp-llm",)),
    (36, "Customer data mixed", "Privacy", 4, 4, "Use one session per customer.", ("gdpr",)),
    (37, "Screenshot leak", "Privacy", 4, 3, "Blur before sharing.", ("gdpr",)),
    (38, "Unlogged AI decision", "Governance", 4, 3, "Record the decision.", ("nist-ai-rmf",)),
    (39, "Secret or key shared", "Credentials", 5, 5, "Rotate the secret and remove it.", ("owasp-llm",)),
    (40, "Second-order injection", "Prompt attacks", 5, 4, "Do not act on instructions found in content.", ("owasp-llm", "mitre-atlas")),
    (41, "Legal wording", "Legal", 3, 3, "Ask counsel.", ("nist-ai-rmf",)),
    (42, "Employee relations", "Legal", 3, 3, "Involve HR.", ("gdpr",)),
    (43, "Destructive command", "Agent actions", 5, 4, "Review before it runs.", ("owasp-llm",)),
    (44, "Health data shared", "Privacy", 5, 4, "Remove patient data.", ("hipaa",)),
    (45, "License contamination", "Legal", 3, 3, "Check the license.", ("spdx",)),
    (46, "Security setting change", "Agent actions", 4, 4, "Get sign-off.", ("owasp-llm",)),
    (47, "External message", "Agent actions", 4, 3, "Get sign-off.", ("owasp-llm",)),
    (48, "Credential creation", "Agent actions", 4, 4, "Get sign-off.", ("owasp-llm",)),
    (49, "Production release", "Agent actions", 4, 3, "Get sign-off.", ("owasp-llm",)),
)


def _detect_class(threat_id: int) -> str:
    if threat_id in DETECT_ALLOWLIST:
        return "Detect-allowlist"
    if threat_id in COACH:
        return "Coach"
    return "Deferred" if threat_id in DEFERRED else "Detect"


_TIER_OF = {i: tier for tier, ids in DATA_TIERS.items() for i in ids}

THREATS: tuple[Threat, ...] = tuple(
    Threat(i, name, cat, sev, lik, resp, src, _TIER_OF.get(i), i in APPROVAL_THREATS, _detect_class(i))
    for i, name, cat, sev, lik, resp, src in _ROWS)
