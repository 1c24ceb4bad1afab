"""Addresses against the standard library, quotas against a sequential restatement."""

import ipaddress
import random

import numpy as np

from hyperslice.functions import rules
from hyperslice.operators import scoring


def internal(ip):
    try:
        a = ipaddress.ip_address(ip)
    except ValueError:
        return False
    return a.is_private or a.is_loopback or a.is_link_local


def test_internal_addresses(spark):
    r = random.Random(11)
    odd = ["0:0:0:0:0:0:0:1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "192.0.0.8", "192.0.0.9", "64:ff9b:1::1", "2001::1", "fe80:zz", "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", "::", "::1", ":::1", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::",
           "::1:2:3:4:5:6:7:8", ":1::", "1::1:", "10.0.0.01", "10.0.0.256", "10.0.0", "10.0.0.1.2", " 10.0.0.1", "10.0.0.1\n", "", None, "abc", "FC00::1", "fdFF::", "::10.0.0.1", "1:2:3:4:5:6:10.0.0.1", "1:2:3:4:5:6:7:10.0.0.1", "::ffff:a00:1", "::ffff:0808:0808", "12345::", "g::1", "255.255.255.255"]
    edges = [str(n[k]) for b in (*rules.INTERNAL, *rules.PUBLIC, *rules.INTERNAL_V6, *rules.PUBLIC_V6) for n in [ipaddress.ip_network(b)] for k in (0, -1)]
    near = [str(ipaddress.ip_address(e) + k) for e in edges for k in (-1, 1) if 0 < int(ipaddress.ip_address(e)) < 2**32 - 1 or 2**32 < int(ipaddress.ip_address(e)) < 2**128 - 1]
    some = [str(ipaddress.IPv4Address(r.getrandbits(32))) for _ in range(4000)]
    for _ in range(6000):
        n = r.getrandbits(128) >> r.choice([0, 0, 16, 64, 96]) if r.random() < 0.5 else int(ipaddress.ip_network(r.choice(rules.INTERNAL_V6 + rules.PUBLIC_V6))[0]) + r.getrandbits(r.choice([4, 60, 100, 122]))
        a = ipaddress.IPv6Address(n % 2**128)
        some.append(r.choice([str(a), a.exploded, str(a).upper()]))
    broken = [s[: r.randint(0, len(s))] + r.choice([":", ".", "0", "f", "::", "%"]) + s[r.randint(0, len(s)) :] for s in r.sample(some, 2000)]
    every = list(dict.fromkeys([*odd, *edges, *near, *some, *broken]))
    rows = spark.createDataFrame([(i, ip) for i, ip in enumerate(every)], "i long, ip string").select("i", rules.is_internal(rules.F.col("ip")).alias("x")).collect()
    wrong = [(every[x["i"]], x["x"]) for x in rows if x["x"] != (every[x["i"]] is not None and internal(every[x["i"]]))]
    assert not wrong and len(rows) == len(every) > 10_000


def restated(sizes, weights, total, floors, per_class):
    """Class after class; labels are list places."""
    there = [c for c, n in enumerate(sizes) if n > 0]
    if not there:
        return {}
    w = np.array([max(weights[c], 0.0) if c in there else 0.0 for c in range(len(sizes))])
    w = w if w.sum() > 0 else np.array([float(c in there) for c in range(len(sizes))])
    raw = w / w.sum() * total
    common = per_class if len(there) * per_class <= total else 0
    q = {c: max(int(np.floor(raw[c])), common, floors.get(c, 0) if floors.get(c, 0) <= total else 0) for c in there}
    need = total - sum(q.values())
    order = sorted(there, key=lambda c: (-(raw[c] - np.floor(raw[c])), c))
    while need > 0:
        for c in order[: need]:
            q[c] += 1
        need -= min(need, len(order))
    for c in sorted(there, key=lambda c: (-q[c], c)):
        take = max(0, min(-need, q[c] - max(common, floors.get(c, 0))))
        q[c] -= take
        need += take
    return q


def test_quotas(spark):
    shares = spark.createDataFrame([(k, float(w)) for k, w in enumerate((50, 40, 5, 5))], "label int, w double")
    got = {r["label"]: r["quota"] for r in scoring.quota_alloc(shares, "w", 20, {2: 4, 3: 4}).collect()}
    assert got == {0: 4, 1: 8, 2: 4, 3: 4}
    r = random.Random(12)
    for _ in range(12):
        n = r.randint(1, 7)
        sizes, weights = [r.choice([0, 3, 9]) for _ in range(n)], [r.choice([0.0, 1.0, 2.0, 5.5]) for _ in range(n)]
        total, per_class = r.randint(0, 40), r.choice([0, 0, 2])
        floors = {c: r.randint(0, 15) for c in range(n) if r.random() < 0.4}
        df = spark.createDataFrame([(c, weights[c], sizes[c]) for c in range(n)], "label int, w double, n int")
        got = {x["label"]: x["quota"] for x in scoring.quota_alloc(df, "w", total, floors, per_class, "n").collect()}
        assert got == restated(sizes, weights, total, floors, per_class)
    big = spark.createDataFrame([(0, 1.0), (1, 1.0)], "label int, w double")
    assert {x["label"]: x["quota"] for x in scoring.quota_alloc(big, "w", 10**12, {0: 6 * 10**11}).collect()} == {0: 6 * 10**11, 1: 4 * 10**11}
