"""Recording files for tests, byte by byte."""

import struct

MARKER = struct.pack("<Q", 0xDEADBEEFDEADBEEF)
FORMS = {0: "Q", 1: "I", 2: "H", 3: "B", 4: "q", 5: "i", 6: "h", 7: "b", 8: "B", 9: "q", 10: "f", 11: "d"}
FORMS |= {14: "ff", 15: "dd"}


def header(signals, version=1):
    out = struct.pack("<QQ", version, len(signals))
    for name, code, dims, formula in signals:
        out += struct.pack("<BI", code, len(dims)) + b"".join(struct.pack("<I", d) for d in dims)
        for text, form in ((name, "<Q"), (formula, "<I")):
            raw = text.encode()
            out += struct.pack(form, len(raw)) + raw
    return out


def value(code, dims, v):
    if code in (12, 13):
        raw = v.encode() if code == 12 else v
        return struct.pack("<Q", len(raw)) + raw
    items = v if dims else [v]
    form = "<" + FORMS[code]
    return b"".join(struct.pack(form, *(i if isinstance(i, tuple) else (i,))) for i in items)


def frame(signals, values):
    bits = bytearray((len(signals) + 7) // 8)
    body = b""
    for i, ((_, code, dims, _), v) in enumerate(zip(signals, values)):
        if v is not None:
            bits[i // 8] |= 1 << (i % 8)
            body += value(code, dims, v)
    return bytes(bits) + body


def recording(signals, rows, version=1):
    return header(signals, version) + b"".join(frame(signals, r) for r in rows) + MARKER


SAMPLE_SIGNALS = [
    ("time_ns", 0, (), "sample timestamp"),
    ("speed", 11, (), "m/s"),
    ("voltage", 10, (), "V"),
    ("status", 12, (), "state label"),
    ("spectrum", 11, (3,), "three-bin spectrum"),
]
SAMPLE_ROWS = [
    (1000, 12.5, 3.3, "warmup", [1.0, 2.0, 3.0]),
    (2000, 15.0, None, "stable", [1.5, 2.5, 3.5]),
    (3000, 9.75, 3.1, None, None),
]
