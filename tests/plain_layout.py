"""The grid of one region by plain loops, for tests: numeric(text) tells what reads as a number."""

import math
from statistics import median

MISSING = None  # set by the tests


def lines_of(words):
    open_ = []
    for w in sorted(words, key=lambda w: (-(w["y0"] + w["y1"]), w["x0"], w["text"])):
        best = None
        for line in open_:
            low, high = min(v["y0"] for v in line), max(v["y1"] for v in line)
            share = (min(high, w["y1"]) - max(low, w["y0"])) / max(0.1, min(high - low, w["y1"] - w["y0"]))
            if share >= 0.5 and (best is None or share >= best[0]):
                best = share, line
        if best:
            best[1].append(w)
        else:
            open_.append([w])
    middle = lambda line: (min(v["y0"] for v in line) + max(v["y1"] for v in line)) / 2
    return [sorted(line, key=lambda w: (w["x0"], w["text"])) for line in sorted(open_, key=lambda x: -middle(x))]


def near_merged(xs, tolerance):
    out = []
    for x in sorted(xs):
        if out and x - out[-1] < tolerance:
            out[-1] = (out[-1] + x) / 2
        else:
            out.append(x)
    return out


def blanks(lines, left, right, h):
    if right - left <= 1:
        return []
    body = [line for line in lines if len(line) >= 2]
    body = body if len(body) >= 2 else lines
    n, gap = int((right - left) / 0.5) + 1, max(3.0, 0.6 * h)
    depth, counted = [0] * n, []
    for line in body:
        mine = set()
        for w in line:
            if w["x1"] - w["x0"] < (right - left) * 0.5:
                counted.append(w)
                mine.update(range(max(0, int((w["x0"] - left) / 0.5)), min(n - 1, int((w["x1"] - left) / 0.5)) + 1))
        for i in mine:
            depth[i] += 1
    few = int(len(body) * 0.06) if len(body) >= 12 else 0
    out, i = [], 0
    while i < n:
        j = i
        while j < n and depth[j] <= few:
            j += 1
        if j > i and counted:
            a, z = left + i * 0.5, left + (j - 1) * 0.5
            if a > min(w["x0"] for w in counted) and z < max(w["x1"] for w in counted):
                inner = sorted((w["x0"], w["x1"]) for w in counted if w["x0"] >= a + gap / 2 and w["x1"] <= z - gap / 2)
                end, parts = a, []
                for x0, x1 in inner:
                    if parts and x0 <= parts[-1][1] + gap:
                        parts[-1][1] = max(parts[-1][1], x1)
                    else:
                        parts.append([x0, x1])
                for x0, x1 in [*parts, [z, z]]:
                    if x0 - end >= gap:
                        out.append((end + x0) / 2)
                    end = x1
        i = max(j, i + 1)
    return out


def grid_of(words, box, horizontal, vertical, numeric, blank, year, merge=True):
    """{(row, col): (span, text, score, boxes, flags, is_header)} of all cells."""
    left, low, right, high = box[0], box[1], box[0] + box[2], box[1] + box[3]
    inside = [w for w in words if left - 1 <= (w["x0"] + w["x1"]) / 2 <= right + 1 and low - 1 <= (w["y0"] + w["y1"]) / 2 <= high + 1]
    if not inside:
        return {}
    lines = lines_of(inside)
    h = max(1, median(w["y1"] - w["y0"] for w in inside))
    inner = [x for x in vertical if left + 3 < x < right - 3]
    if len(inner) >= 2:
        cuts = near_merged(inner, 3)
    else:
        cuts = blanks(lines, left, right, h)
        cuts = near_merged(cuts + inner, h) if inner else cuts
    edges = sorted({left, right, *cuts})
    cols = list(zip(edges, edges[1:], strict=False))

    def place(w):
        over = [min(w["x1"], b) - max(w["x0"], a) for a, b in cols]
        if max(over) <= 0:
            mid = (w["x0"] + w["x1"]) / 2
            return min(range(len(cols)), key=lambda i: abs(sum(cols[i]) / 2 - mid)), 1, True
        big = [i for i, o in enumerate(over) if o > 0 and o >= 0.2 * max(0.1, w["x1"] - w["x0"]) and o > 0.4 * h]
        if len(big) > 1:
            return big[0], big[-1] - big[0] + 1, True
        return over.index(max(over)), 1, False

    bottom, top = lambda line: min(w["y0"] for w in line), lambda line: max(w["y1"] for w in line)
    across = [y for y in horizontal if low + 2 < y < high - 2]
    ruled = len(across) >= 2 and len(across) >= 0.45 * len(lines)
    rows = []
    if ruled:
        bands = near_merged(across, 2)
        last = None
        for line in lines:
            band = sum(y >= (bottom(line) + top(line)) / 2 for y in bands)
            if band == last:
                rows[-1].append(line)
            else:
                rows.append([line])
            last = band
    else:
        gaps = [bottom(a) - top(b) for a, b in zip(lines, lines[1:], strict=False)]
        usual = median(gaps) if gaps else 0
        for line in lines:
            mine = {place(w)[0] for w in line}
            go = merge and bool(rows) and len(cols) > 1 and 0 not in mine and not any(numeric(w["text"]) for w in line)
            if go:
                gap = bottom(rows[-1][-1]) - top(line)
                have = {place(w)[0] for x in rows[-1] for w in x}
                go = gap <= max(0.6 * h, 0.9 * usual) and (usual <= 0 or gap <= 0.9 * usual + 0.5) and (0 in have or len(rows[-1]) > 1) and mine <= have
            if go:
                rows[-1].append(line)
            else:
                rows.append([line])
    cells, spans = {}, {}
    for r, row in enumerate(rows):
        for k, line in enumerate(row):
            for w in line:
                c, s, crossed = place(w)
                cells.setdefault((r, c), []).append((w, (r, k), crossed))
                spans[r, c] = max(spans.get((r, c), 1), s)
    used = sorted({c for _, c in cells})
    new = {c: i for i, c in enumerate(used)}
    spans = {(r, new[c]): max(new[x] for x in used if x < c + s) - new[c] + 1 for (r, c), s in spans.items()}
    cells, n = {(r, new[c]): v for (r, c), v in cells.items()}, len(used)
    plain = {k: " ".join(w["text"] for w, _, _ in v) for k, v in cells.items()}

    def heads():
        if len(rows) <= 1:
            return 0
        start, numeric_cols, year_cols = min(len(rows) - 1, max(1, len(rows) // 3)), set(), set()
        for c in range(n):
            values = [t for (r, k), t in plain.items() if k == c and r >= start and not blank(t)]
            if values and sum(map(numeric, values)) / len(values) >= 0.7:
                numeric_cols.add(c)
            if values and sum(map(year, values)) / len(values) >= 0.7:
                year_cols.add(c)
        if not numeric_cols:
            return 1
        count = 0
        for r in range(min(4, len(rows) - 1)):
            judged = [(c, plain[r, c]) for c in numeric_cols if (r, c) in plain and not blank(plain[r, c])]
            like = [t for c, t in judged if not numeric(t) or (year(t) and c not in year_cols)]
            if any(s > 1 for (x, _), s in spans.items() if x == r) or not judged or len(like) >= 0.5 * len(judged):
                count += 1
            else:
                break
        under = [y for y in across if not ruled and y < min(map(bottom, rows[0]))]
        if under:
            over = 0
            while over < len(rows) and min(map(bottom, rows[over])) > max(under):
                over += 1
            if 0 < over <= 3 and len(rows) > over:
                return over
        return min(count, 3)

    head = heads()
    if head and len(inner) < 2:
        is_head = {c: {r < head for r, k in cells if k == c} for c in range(n)}
        to, c = {}, 0
        order = []
        while c < n:
            if is_head[c] == {True} and is_head.get(c + 1) == {False}:
                order.append([c, c + 1])
                c += 2
            elif is_head[c] == {True} and order and len(order[-1]) == 1 and is_head[order[-1][0]] == {False}:
                order[-1].append(c)
                c += 1
            else:
                order.append([c])
                c += 1
        to = {c: i for i, group in enumerate(order) for c in group}
        spans = {(r, to[c]): to[c + s - 1] - to[c] + 1 for (r, c), s in spans.items()}
        cells, n = {(r, to[c]): v for (r, c), v in cells.items()}, len(order)
    out = {}
    for r in range(len(rows)):
        c = 0
        while c < n:
            span = spans.get((r, c), 1) if r < head else 1
            mine = sorted((x for k in range(c, c + span) for x in cells.get((r, k), [])), key=lambda x: (x[1], x[0]["x0"]))
            text, before, boxes = "", None, []
            for w, _, _ in mine:
                mid = (w["y0"] + w["y1"]) / 2
                if before is not None:
                    same = abs(mid - (before["y0"] + before["y1"]) / 2) < 0.5 * h
                    text += "" if same and w["x0"] - before["x1"] < 0.05 * h and before["text"].endswith("-") else " "
                text, before = text + w["text"], w
                for b in boxes:
                    if abs((b[2] + b[3]) / 2 - mid) < 0.5 * h and w["x0"] - b[1] < 1.5 * h:
                        b[:] = min(b[0], w["x0"]), max(b[1], w["x1"]), min(b[2], w["y0"]), max(b[3], w["y1"])
                        break
                else:
                    boxes.append([w["x0"], w["x1"], w["y0"], w["y1"]])
            crossed = any(x[2] for x in mine)
            levels = {math.trunc((w["y0"] + w["y1"]) / 2 / max(1, 0.5 * h)) for w, _, _ in mine}
            flags = [f for f, on in (("continuationMerged", len(rows[r]) > 1 and not ruled and len(levels) > 1), ("spansColumns", span > 1), ("outsideColumns", crossed and span == 1 and r >= head)) if on]
            scores = [w["score"] for w, _, _ in mine if w["score"] is not None]
            out[r, c] = span, text.strip(), min(scores, default=None), [tuple(round(v, 6) for v in (b[0], b[2], b[1] - b[0], b[3] - b[2])) for b in boxes], flags, r < head
            c += span
    return out
