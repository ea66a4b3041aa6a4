"""Test-side access to the comparison helpers in tools/compare.py."""

import hashlib
import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare import kind, rows_key  # noqa: E402


def compare_frames(sdf, rel):
    srows, scols = sdf.collect(), sdf.columns
    stypes = [kind(f.dataType.simpleString()) for f in sdf.schema.fields]
    dcols = [d[0] for d in rel.description]
    dtypes = [kind(str(d[1])) for d in rel.description]
    drows = rel.fetchall()
    s_idx = sorted(range(len(scols)), key=lambda i: scols[i])
    d_idx = sorted(range(len(dcols)), key=lambda i: dcols[i])
    a, b = rows_key(srows, s_idx), rows_key(drows, d_idx)
    out = {
        "rows": (len(srows), len(drows)),
        "names": [scols[i] for i in s_idx] == [dcols[i] for i in d_idx],
        "types": [stypes[i] for i in s_idx] == [dtypes[i] for i in d_idx],
        "hash": hashlib.sha1(repr(a).encode()).hexdigest() == hashlib.sha1(repr(b).encode()).hexdigest(),
    }
    out["ok"] = out["names"] and out["types"] and out["hash"] and len(srows) == len(drows)
    if not out["ok"]:
        out["diff"] = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return out
