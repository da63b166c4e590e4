"""Scanned pages against plain versions."""

import random

from quarterlode.operators import boxes


def plain_rows(items):
    rows, row, anchor = [], [], None
    for b in sorted(items, key=lambda b: (b[1], b[0], b[4])):
        if anchor is None or abs(b[1] - anchor) <= max(0.009, b[3] * 0.45):
            row.append(b)
            anchor = b[1] if anchor is None else (anchor * (len(row) - 1) + b[1]) / len(row)
            continue
        rows.append(row)
        row, anchor = [b], b[1]
    return [sorted(r, key=lambda b: (b[0], b[1], b[4])) for r in [*rows, row]]


def plain_grid(items):
    rows, anchors = plain_rows(items), []
    for b in (b for r in rows for b in r):
        k = next((i for i, a in enumerate(anchors) if abs(b[0] - a) <= 0.065), None)
        if k is None:
            anchors = sorted([*anchors, b[0]])
        else:
            anchors[k] = (anchors[k] + b[0]) / 2
    anchors.sort()
    lines = []
    for r in rows:
        cells = {}
        for b in r:
            cells.setdefault(min(range(len(anchors)), key=lambda i: abs(anchors[i] - b[0])), []).append(b[4])
        lines.append((min(b[1] for b in r), " | ".join(" ".join(cells[i]) for i in sorted(cells))))
    return [line for _, line in sorted(lines, key=lambda x: x[0])] if len(anchors) >= 2 else []


def test_jittered_tables(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for page in range(40):
        items = []
        for i in range(rng.randint(1, 12)):
            for x in rng.sample((0.05, 0.3, 0.45, 0.6, 0.8), rng.randint(1, 5)):
                items.append((x + rng.uniform(-0.04, 0.04), 0.1 + i * rng.choice((0.012, 0.02, 0.03)) + rng.uniform(-0.004, 0.004), 0.05, rng.choice((0.01, 0.03)), f"t{page}x{len(items)}"))
        rows += [(page, *b) for b in items]
        want[page] = plain_grid(items)
    df = spark.createDataFrame(rows, "page int, x double, y double, width double, height double, text string")
    got = {}
    for r in sorted(boxes.grid_lines(df, ("page",)).collect(), key=lambda r: (r.page, r.line_no)):
        got.setdefault(r.page, []).append(r.line)
    assert got == {p: lines for p, lines in want.items() if lines}


def test_one_column_and_empty_pages_have_no_grid(spark):
    df = spark.createDataFrame([(1, 0.1, 0.1, 0.1, 0.01, "a"), (1, 0.12, 0.2, 0.1, 0.01, "b"), (2, 0.1, 0.1, 0.1, 0.01, " "), (3, None, None, None, None, None)], "page int, x double, y double, width double, height double, text string")
    assert boxes.grid_lines(df, ("page",)).count() == 0
    assert [r.line for r in boxes.spaced_lines(df, ("page",)).orderBy("page", "line_no").collect()] == ["a", "b"]


def plain_merge(lines, kinds):
    merged, i = [], 0
    while i < len(lines):
        label, section, _ = kinds(lines[i])
        if label and i + 1 < len(lines) and "|" in lines[i + 1] and kinds(lines[i + 1])[2] >= 2 and not section:
            merged.append(f"{lines[i]} {lines[i + 1]}".strip())
            i += 2
            continue
        merged.append(lines[i])
        i += 1
    out = []
    for line in merged:
        first = line.split("|", 1)[0].strip() if "|" in line else line
        words = first.split()
        numeric = bool(words) and all(w.strip("$()%-").replace(",", "").replace(".", "").isdigit() for w in words)
        if out and "|" in line and kinds(line)[2] >= 2 and "|" in out[-1] and (not first or (numeric and kinds(out[-1].split("|", 1)[0].strip())[0])):
            out[-1] = f"{out[-1]} | {' | '.join(p.strip() for p in line.split('|') if p.strip())}"
            continue
        out.append(line)
    return out


def test_wrapped_rows_and_further_numbers(spark):
    def kinds(line):
        number = lambda w: w.strip("$()%-").replace(",", "").replace(".", "").isdigit()
        cells = sum(any(number(w) for w in c.split()) for c in line.split("|")[1:]) if "|" in line else 0
        label = bool(line) and "|" not in line and not any(map(number, line.split())) and len(line) <= 90 and not line.endswith(".")
        return label, line.endswith(":") or line == "Operating expenses", cells

    pool = ["Revenue from things", "and services", "Operating expenses", "Other:", "| 1 | 2", "12 | 3 | 4", "Sales | 5 | 6", "Cost 7 | 8 | 9", "A sentence 1.", "Net | only", "(3) | 4 | 5", "x | 1"]
    rng = random.Random(2)
    pages = [[rng.choice(pool) for _ in range(rng.randint(1, 14))] for _ in range(300)]
    df = spark.createDataFrame([(p, i, line) for p, lines in enumerate(pages) for i, line in enumerate(lines)], "page int, line_no int, line string")
    got = {}
    for r in sorted(boxes.merge_wrapped(df, ("page",)).collect(), key=lambda r: (r.page, r.line_no)):
        got.setdefault(r.page, []).append(r.line)
    assert got == {p: plain_merge(lines, kinds) for p, lines in enumerate(pages)}
