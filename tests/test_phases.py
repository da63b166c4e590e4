"""Regimes, phases and subsets against plain versions on random histories."""

import itertools
import random

from pyspark.sql import functions as F

from quarterlode.operators import phases, subsets, templates

WHOLE = "Consolidated total company"  # reads like a total


def optional(key, name):
    return key in ("", "otherrevenue", "reportedrevenue") or name == WHOLE


def profile(rows):
    kept = [r for r in rows if r[0] != "reportedrevenue" and r[1] > 20]
    plain = [r for r in kept if not r[2]]
    return plain if len(plain) >= 2 else kept


def align(a, c):
    if a["style"] and c["style"] and a["style"] != c["style"]:
        return False, "style-mismatch", []
    pa, pc, rows, bundled = profile(a["rows"]), profile(c["rows"]), list(c["rows"]), False
    if len(pa) < 2 or len(pc) < 1:
        return False, "insufficient-profile", []
    keys = lambda rs: {r[0] for r in rs}
    missing, extra = [r for r in pa if r[0] not in keys(pc)], [r for r in pc if r[0] not in keys(pa)]
    if len(missing) == 1 and 1 <= len(extra) <= 3 and len(pa) - 1 >= 2:
        value = sum(r[1] for r in rows if r[0] in keys(extra))
        m, e = missing[0][1] / max(a["total"], 1), value / max(c["total"], 1)
        if (m > 0.1 and e > 0.1 and 0.55 <= e / max(m, 0.001) <= 1.8) or abs(m - e) <= 0.18:
            rows = [r for r in rows if r[0] not in keys(extra)] + [(missing[0][0], value, missing[0][2])]
            bundled = True
            pc = profile(rows)
            missing, extra = [r for r in pa if r[0] not in keys(pc)], [r for r in pc if r[0] not in keys(pa)]
    both = [r for r in pa if r[0] in keys(pc)]
    share = lambda rs, t: sum(r[1] for r in rs) / max(t, 1)
    jaccard = len(both) / max(len(keys(pa) | keys(pc)), 1)
    ca, cq = share(both, a["total"]), share([r for r in pc if r[0] in keys(both)], c["total"])
    styled = bool(a["style"]) and a["style"] == c["style"] and len(both) >= 2 and ca >= 0.45
    schema = len(both) >= 2 and (jaccard >= 0.58 or (ca >= 0.55 and cq >= 0.55 and share(missing, a["total"]) <= 0.26 and share(extra, c["total"]) <= 0.26))
    if not styled and not schema:
        return False, "schema-mismatch", []
    gone = {r[0] for r in extra if r[2] or r[1] / max(c["total"], 1) <= 0.08}
    kept = sorted((r for r in rows if r[0] not in gone and r[1] > 20), key=lambda r: (-r[1], r[0]))
    return True, "schema-bundled" if bundled else "schema-compatible", kept


def walk(history):
    """(phase, anchor) by place; the loop as it is told."""
    found, out = [], [None] * len(history)
    for i, c in enumerate(history):
        pc = profile(c["rows"])
        if not c["reliable"] or len(pc) < 2:
            continue
        opens = not found
        if found:
            a = history[found[-1]]
            pa = profile(a["rows"])
            if len(pa) >= 2 and [r[0] for r in pa] != [r[0] for r in pc]:
                f, r = align(a, c), align(c, a)
                both, three = {x[0] for x in pa} & {x[0] for x in pc}, len(pa) >= 3 and len(pc) >= 3
                opens = ("schema-bundled" in (f[1], r[1]) and three) or (not f[0] and not r[0]) or (three and len(both) / len({x[0] for x in pa} | {x[0] for x in pc}) < 0.75)
        if opens:
            found.append(i)
        elif c["score"] >= history[found[-1]]["score"]:
            found[-1] = i
        out[i] = len(found) - 1
    for i in range(1, len(out) - 1):
        if out[i] is None and out[i - 1] is not None and out[i - 1] == out[i + 1]:
            out[i] = out[i - 1]
    return [(p, None if p is None else found[p]) for p in out]


def histories(seed, n=40):
    rng = random.Random(seed)
    names = ["cloud", "ads", "devices", "games", "retail", "tv"]
    out = []
    for _ in range(n):
        history, keys, style = [], rng.sample(names, rng.randint(2, 6)), rng.choice(("", "x"))
        for _ in range(24):
            if rng.random() < 0.12:
                keys, style = rng.sample(names, rng.randint(1, 6)), rng.choice((style, "", "y"))
            mine = {k: (rng.choice((15, 400, 900, 2500, 3000)), k) for k in keys if rng.random() < 0.95}
            if len(mine) > 3 and rng.random() < 0.3:  # two or three at once
                some = rng.sample(sorted(mine), rng.randint(2, 3))
                mine["bundle"] = (sum(mine.pop(k)[0] for k in some), "bundle")
            if rng.random() < 0.2:
                mine[rng.choice(("otherrevenue", "reportedrevenue", "whole"))] = (rng.choice((100, 900)), WHOLE)
            rows = sorted(((k, v, optional(k, name)) for k, (v, name) in mine.items()), key=lambda r: (-r[1], r[0]))
            total = int(sum(r[1] for r in rows) * rng.choice((0.8, 1, 1, 1.3))) or 500
            source, cover = rng.randint(0, 60), rng.choice((0.5, 0.9, 1.0))
            history.append({"rows": rows, "names": {k: name for k, (_, name) in mine.items()}, "total": total, "style": style, "reliable": rng.random() < 0.9, "source": source, "coverage": cover, "score": len(profile(rows)) * 20 + source + cover * 12 + total / 1000 * 0.01})
        out.append(history)
    return out


def frame(spark, every):
    rows = [(c, i, k, q["names"][k], v / 1000) for c, h in enumerate(every) for i, q in enumerate(h) for k, v, _ in q["rows"]]
    quarters = [(c, i, q["total"] / 1000, q["style"] or None, q["reliable"], q["source"], q["coverage"]) for c, h in enumerate(every) for i, q in enumerate(h)]
    segments = spark.createDataFrame(rows, "company_id int, q_index int, member_key string, name string, value double").withColumn("value", F.col("value").cast("decimal(24,3)"))
    at = spark.createDataFrame(quarters, "company_id int, q_index int, total double, style string, reliable boolean, source_score int, coverage double").withColumn("total", F.col("total").cast("decimal(20,3)"))
    return phases.profiles(segments, at)


def test_pairs_and_phases_equal_plain_versions(spark):
    every = histories(3)
    at = frame(spark, every).cache()
    seen = set()
    for r in phases.align_pairs(at, span=5).collect():
        want = align(every[r.company_id][r.q_index], every[r.company_id][r.q2])
        assert (r.comparable, r.reason, [(x.key, x.v, x.opt) for x in r.rows]) == want, (r, want)
        seen.add(r.reason)
    assert seen == {"style-mismatch", "insufficient-profile", "schema-mismatch", "schema-bundled", "schema-compatible"}
    got = {(r.company_id, r.q_index): (r.phase, r.anchor) for r in phases.phases(at).collect()}
    want = {(c, i): p for c, h in enumerate(every) for i, p in enumerate(walk(h))}
    assert got == want and max(p for p, _ in want.values() if p is not None) >= 3


def test_a_bundled_shift_opens_a_phase_and_holes_are_bridged(spark):
    full = [("a", 400, False), ("b", 300, False), ("c", 200, False), ("d", 100, False)]
    merged = [("ab", 700, False), ("c", 200, False), ("d", 100, False)]
    quarter = lambda rows, **more: {"rows": rows, "names": {r[0]: r[0] for r in rows}, "total": 1000, "style": "", "reliable": True, "source": 0, "coverage": 1.0} | more
    history = [quarter(full), quarter(full, source=5), quarter([("reportedrevenue", 1000, True)]), quarter(full), quarter(merged), quarter(merged), quarter(merged, reliable=False), quarter(full)]
    got = {r.q_index: (r.phase, r.anchor, r.member) for r in phases.phases(frame(spark, [history])).collect()}
    assert got == {0: (0, 1, True), 1: (0, 1, True), 2: (0, 1, False), 3: (0, 1, True), 4: (1, 5, True), 5: (1, 5, True), 6: (None, None, False), 7: (2, 7, True)}


def test_conceptual_quarters_are_no_templates(spark):
    rows = [(1, q, k, n, 1.0) for q in range(2) for k, n in (("x", "Service charges" if q else "Cloud"), ("y", "Fees and commissions" if q else "Ads"))]
    segments = spark.createDataFrame(rows, "company_id int, q_index int, member_key string, name string, value double").withColumn("value", F.col("value").cast("decimal(24,3)"))
    flags = {"has_raw": True, "reported_only": False, "insufficient": False, "harmonize": False, "reliable": True}
    at = spark.createDataFrame([(1, q) for q in range(2)], "company_id int, q_index int").withColumns({k: F.lit(v) for k, v in flags.items()} | {"total": F.lit(2).cast("decimal(20,3)"), "style": F.lit(None).cast("string"), "source": F.lit("official"), "coverage": F.lit(1.0), "source_score": F.lit(0)})
    got = {r.q_index: (r.conceptual, r.template) for r in templates.reliable_templates(phases.phases(phases.profiles(segments, at))).collect()}
    assert got == {0: (False, True), 1: (True, False)}


def best(items, revenue, targets, own):
    """Exhaustive, as told: masks in order, a later one wins by score, or within 0.01 with fewer rows."""
    words = [{w for w in "".join(c if c.isalnum() else " " for c in n.lower()).split() if w not in subsets.WORD_STOP and w not in own} for n, _ in items]
    key = lambda n: "".join(c for c in n.lower() if c.isalnum())
    cost = lambda n: (220 + 110 if "consolidated" in n.lower() else 0) + (32 if n.lower() == "all other segments" else 0)
    need = {key(t) for t in targets if any(key(n) == key(t) for n, _ in items)}
    need = {key(t) for t in targets} if need else set()
    top = None
    for mask in range(1, 1 << len(items)):
        at = [i for i in range(len(items)) if mask >> i & 1]
        total, n = sum(items[i][1] for i in at), len(at)
        if n > 7 or (n == 1 and len(items) > 1) or not need <= {key(items[i][0]) for i in at} or not 0.45 <= total / revenue <= 1.35:
            continue
        r = total / revenue
        shared = sum(len(words[i] & words[j]) for i, j in itertools.combinations(at, 2)) * 28
        score = (44 if 3 <= n <= 6 else 0) - abs(total - revenue) / 1000 * 110 - ((n - 5) * 18 if n > 5 else (3 - n) * 40 if n < 3 and len(items) > 3 else 0) - ((0.78 - r) * 260 if r < 0.78 else (r - 1.08) * 360 if r > 1.08 else 0) - sum(cost(items[i][0]) for i in at) - shared
        if top is None or score > top[0] or (abs(score - top[0]) < 0.01 and n < top[1]):
            top = (score, n, at)
    return ("subset", [items[i][0] for i in top[2]]) if top else ("largest", [n for n, _ in items[:7]])


def test_subsets_equal_exhaustive_search(spark):
    rng = random.Random(5)
    pool = ["Cloud", "Cloud services", "Ads", "Mobile Ads", "Devices", "Consolidated things", "All other segments", "Games", "Games & TV", "Retail North", "Retail South", "Acme Labs", "Energy"]
    rows, quarters, targets, want = [], [], [], {}
    for q in range(60):
        items = sorted(((n, rng.randint(30, 4000)) for n in rng.sample(pool, rng.randint(1, 12))), key=lambda x: (-x[1], x[0]))
        revenue = int(sum(v for _, v in items) * rng.choice((0.2, 0.5, 0.7, 1.5, 3)))
        mine = rng.sample([n for n, _ in items], 1) if rng.random() < 0.4 else []
        rows += [(1, q, n, v / 1000) for n, v in items]
        quarters.append((1, q, revenue / 1000, False, "Acme Inc"))
        targets += [(1, q, t) for t in mine]
        total, n = sum(v for _, v in items), len(items)
        fits = (mine and n <= 7 and 0.72 <= total / revenue <= 1.18) or (3 <= n <= 6 and 0.88 <= total / revenue <= 1.18)
        want[q] = ("all", [n for n, _ in items]) if fits else best(items, revenue, mine, {"acme", "inc"})
    money = lambda df, *c: df.withColumns({x: F.col(x).cast("decimal(24,3)") for x in c})
    got = subsets.best_subset(
        money(spark.createDataFrame(rows, "company_id int, q_index int, name string, value double"), "value").withColumn("member_key", F.lit(None).cast("string")),
        money(spark.createDataFrame(quarters, "company_id int, q_index int, revenue double, styled boolean, company_name string"), "revenue"),
        spark.createDataFrame(targets, "company_id int, q_index int, target string"),
    ).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.q_index, -r.value, r.name)):
        found.setdefault(r.q_index, (r.how, []))[1].append(r.name)
    assert found == want and {how for how, _ in want.values()} >= {"subset", "largest"}
