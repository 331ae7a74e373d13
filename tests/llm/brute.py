"""Plain row-by-row statements of what the operators must return, for tests."""

import hashlib
import re

A = re.ASCII


def digest(spans, order):
    spans = sorted(spans, key=lambda x: (x[1], order.index(x[0]), x[2]))
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    return hashlib.sha256(joined.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    counts = [sum(x[0] == k for x in out) for k in ("email", "ip", "card", "phone")]
    return (*counts, digest(out, ["email", "ip", "card", "phone"]))


def secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | A):
        if len(m[2]) >= 8:
            out.append(("assign", m.start(), m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 16:
            out.append(("access", m.start(), m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 32:
            out.append(("hex", m.start(), m.end()))
    counts = [sum(x[0] == k for x in out) for k in ("assign", "access", "hex")]
    return (*counts, digest(out, ["assign", "access", "hex"]))
