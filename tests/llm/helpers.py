"""Small fixtures and brute-force versions."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, tkey string, score string"


def docs(spark, rows):
    """Documents from (doc_id, text) with columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "src0", len(t) if t is not None else None, "node", "tkey", "score") for i, t in rows], DOCS)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, k):
    w = spaced(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows, k, num, den):
    """doc_id -> (set size, smallest doc_id that links reach)."""
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    label = {i: i for i, _ in sets}
    links = []
    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                links.append((sets[x][0], sets[y][0]))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: (len(s), label[i]) for i, s in sets}
