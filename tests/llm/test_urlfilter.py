import random
from datetime import datetime, timedelta

import pytest

from gleaner.llm import urlfilter as U

T0 = datetime(2024, 1, 1)


def brute(captures, entries):
    out = []
    for cid, url, at in captures:
        host = url.split("://")[1].split("/")[0].split(":")[0].lower() if url and "://" in url else None
        path = ("/" + url.split("://")[1].partition("/")[2]).split("?")[0].split("#")[0] if host else ""
        active = []
        for p in {(c, k, h, q) for c, k, h, q, _, _ in entries}:
            events = {}
            for *x, a, t in entries:
                if tuple(x) == p:
                    events[t] = "remove" if "remove" in (a, events.get(t)) else a
            past = [t for t in events if at is not None and t <= at]
            if host and past and events[max(past)] == "add":
                c, k, h, q = p
                if (k == "domain" and (host == h or host.endswith("." + h))) or (k == "host" and host == h) or (k == "prefix" and host == h and path.startswith(q)):
                    active.append((c, len(h.split(".")) * 100_000 + {"domain": 0, "host": 1}.get(k, len(q) + 1)))
        worst = max((r for c, r in active if c != "allow"), default=-1)
        best = max((r for c, r in active if c == "allow"), default=-1)
        out.append((cid, len(active), ",".join(sorted({c for c, _ in active})), worst > best))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [1000, 0])
def test_against_brute_force(spark, rows):
    rng = random.Random(rows)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "ba.com"]
    entries = []
    for _ in range(60):
        k = rng.choice(["host", "domain", "prefix"])
        entries.append((rng.choice(["ads", "adult", "allow"]), k, rng.choice(hosts), rng.choice(["/en/", "/en/x"]) if k == "prefix" else "", rng.choice(["add", "add", "remove"]), T0 + timedelta(days=rng.randint(0, 20))))
    captures = [(i, rng.choice(["http", "https"]) + "://" + rng.choice(hosts).upper() + rng.choice(["", ":80"]) + rng.choice(["", "/", "/en/", "/en/x?q=/de/", "/de#a"]), T0 + timedelta(days=rng.randint(0, 25))) for i in range(120)]
    captures += [(200, None, T0), (201, "no url", T0), (202, captures[0][1], None), captures[0], (None, captures[1][1], captures[1][2])]
    df = spark.createDataFrame([(*c, "n") for c in captures], "page_id long, url string, fetched timestamp, host string")
    ent = spark.createDataFrame([*entries, entries[0], (None, "host", None, "", "add", T0)], "category string, kind string, host string, path string, action string, at timestamp")
    got = U.evaluate(df, ent, broadcast_rows=rows).collect()
    assert sorted(((r.page_id, r.n_active, r.categories, r.blocked) for r in got), key=str) == brute(captures, entries)
    assert U.evaluate(df.limit(0), ent).count() == 0 and U.evaluate(df, ent.limit(0)).filter("n_active > 0 or blocked").count() == 0


def test_query_equals_its_sql(spark):
    from tests.oracle import connect, differences

    sf = "/root/testdata/sf0.01"
    n, m, extra, missing = differences(spark, connect(sf), U.op2_urlfilter, U.OP2_SQL, sf)
    assert n == m == 250 and not extra and not missing
    assert U.op2_urlfilter(spark, sf).filter("blocked").count() > 10
