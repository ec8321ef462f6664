"""A plain-Python statement of the expected semantics, for small fixtures only."""

import re
from functools import cache

from glasswatch.functions import refine  # noqa: F401
from glasswatch.rules.catalog import THREATS
from glasswatch.rules.detectors import DETECTORS
from glasswatch.rules.model import LEVEL_RANK, wanted_stages

BY_ID = {t.threat_id: t for t in THREATS}


@cache
def compiled(p):
    flags = 0
    for letter, f in (("i", re.I), ("s", re.S), ("m", re.M)):
        if letter in p.flags:
            flags |= f
    src = p.source.replace(r"\d", "[0-9]") if "[" not in p.source else p.source
    if src.isascii():
        flags |= re.A
    if src.startswith("(?s)"):
        src, flags = src[4:], flags | re.S
    return re.compile(src[:-1] + r"\Z" if src.endswith("$") else src, flags)


def strong(m):
    import math
    v = re.search(r"[\"']([^\"']+)[\"']$", m)
    if not v:
        return False
    v = v.group(1)
    bits = -sum(v.count(c) / len(v) * math.log2(v.count(c) / len(v)) for c in set(v))
    uuid = re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", v, re.I)
    sha = re.fullmatch(r"[0-9a-f]{40}", v, re.I)
    return len(v) >= 20 and not uuid and not sha and bits >= 3.5


def clip(s):
    s = re.sub(r"\s+", " ", s).strip()
    return s[:48] + "…" if len(s) > 48 else s


def match(text, d):
    for p in d.patterns:
        if d.refine:
            for m in compiled(p).finditer(text):
                if strong(m.group(0)):
                    return m.group(0)
            continue
        m = compiled(p).search(text)
        if m:
            return m.group(0) or None
    return None


def in_stage(d, stage):
    return any(s in wanted_stages(stage) for s in d.where)


def reduce(found):
    """[(detector, match)] in order -> ranked [(threat, detector id, match)]."""
    slot = {}
    for d, m in found:
        if d.threat_id in BY_ID and (d.threat_id not in slot or d.mode == "warn"):
            slot[d.threat_id] = (d.threat_id, d.detector_id, m)
    return sorted(slot.values(), key=lambda x: (-LEVEL_RANK[BY_ID[x[0]].risk_level], -BY_ID[x[0]].risk_score))


def scan(text, stage, detectors=DETECTORS):
    if not text or not text.strip():
        return []
    return reduce([(d, clip(m)) for d in detectors if in_stage(d, stage) and (m := match(text, d))])


def redact(text, stage, detectors=DETECTORS):
    for d in detectors:
        if not in_stage(d, stage) or d.mode == "coach":
            continue
        for p in d.patterns:
            tag = f"[REDACTED:#{d.threat_id}]"
            text = compiled(p).sub(lambda m: tag if not d.refine or strong(m.group(0)) else m.group(0), text)
    return text


def first(text, patterns):
    return next((m.group(0) for p in patterns if (m := compiled(p).search(text))), None)


def scan_session(turns, window=6, detectors=DETECTORS):
    recent = [t for t in turns if t and t.strip()][-window:]
    if len(recent) < 2:
        return []
    joined = "\n".join(recent)
    inj = [d for d in detectors if d.stage == "prompt" and d.detector_id.startswith("inj")]
    found = [(d, clip(m)) for d in detectors if (d in inj or d.stage == "session") and (m := first(joined, d.patterns))]
    flagged = sum(any(first(t, d.patterns) for d in inj) for t in recent)
    if flagged >= 2:
        from glasswatch.rules.model import Detector
        found.append((Detector("inj-persistent", 3, ()), f"{flagged} turns"))
    return reduce(found)


def lines(chunks, limit=8192, keep=4096):
    buffer, out = "", []
    for c in chunks:
        buffer += c
        nl = buffer.rfind("\n")
        if nl < 0:
            if len(buffer) > limit:
                buffer = buffer[-keep:]
            continue
        out.append(buffer[:nl])
        buffer = buffer[nl + 1:]
    return out
