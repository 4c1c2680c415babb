"""Plain-Python decoder over dense score dictionaries, written without Spark.

``scores[lvl]`` maps label -> probability in column order, ``kids[lvl]`` maps parent -> list
of children in list order.
"""

import random


def argmax(labels, probs):
    best = None
    for x in labels:
        if best is None or probs[x] > probs[best]:
            best = x
    return best


def parents_of(kids):
    return [{c: p for p, cs in level.items() for c in cs} for level in kids]


def walk(scores, kids, start):
    """The path from one start level, or None when a step is impossible."""
    n, path = len(scores), {}
    label = argmax(scores[start], scores[start])
    path[start] = label
    for k in range(start + 1, n):
        known = [c for c in kids[k - 1].get(path[k - 1], []) if c in scores[k]]
        if not known:
            return None
        path[k] = argmax(known, scores[k])
    up = parents_of(kids)
    for k in range(start - 1, -1, -1):
        parent = up[k].get(path[k + 1])
        if parent is None or parent not in scores[k]:
            return None
        path[k] = parent
    return [(path[k], scores[k][path[k]]) for k in range(n)]


def best_path(scores, kids):
    best, best_conf = None, 0.0
    for start in range(len(scores)):
        path = walk(scores, kids, start)
        if path is None:
            continue
        total = 1.0
        for _, p in path:
            total *= p
        conf = total ** (1.0 / len(path))
        if conf > best_conf:
            best, best_conf = (start, path), conf
    return (best[0], best[1], best_conf) if best else None


def gated(scores, kids, thresholds):
    n = len(scores)
    out = [None] * n
    label = argmax(scores[0], scores[0])
    out[0] = (label, scores[0][label])
    for k in range(1, n):
        known = [c for c in kids[k - 1].get(out[k - 1][0], []) if c in scores[k]]
        if not known:
            break
        label = argmax(known, scores[k])
        if not scores[k][label] >= thresholds[k]:
            break
        out[k] = (label, scores[k][label])
    if out[0][1] < thresholds[0]:
        out[0] = None
    score = 1.0
    for cell in out:
        score *= cell[1] if cell else 1.0
    return out, score


def random_tree(rng: random.Random, widths):
    """A strict hierarchy whose child lists are shuffled; some labels are left out of it."""
    kids = []
    for k in range(len(widths) - 1):
        level = {p: [] for p in range(widths[k])}
        for c in range(widths[k + 1]):
            if rng.random() < 0.95:
                level[rng.randrange(widths[k])].append(c)
        for cs in level.values():
            rng.shuffle(cs)
        kids.append({p: cs for p, cs in level.items() if cs})
    return kids


def random_scores(rng: random.Random, widths, grid=8):
    """Coarse probabilities, so that ties and zeros are frequent; column order is shuffled."""
    out = []
    for w in widths:
        labels = list(range(w))
        rng.shuffle(labels)
        out.append({x: rng.choice([0, 0, *range(grid)]) / grid for x in labels})
    return out
