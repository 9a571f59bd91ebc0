"""Plain Python versions of what the operators compute."""

import collections
import hashlib
import math
import re
import unicodedata

from spanloom.llm import mixing, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def near_classes(texts):
    """For each of the given texts (id -> text) the least id of its class."""
    sets, up = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (texts[a] == texts[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in texts}


def features(text):
    """Base counts and ratios of a text by name."""
    w = WORD.findall(text)
    seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    repeated = len({k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)})
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, chars, symbols = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text))
    share = lambda a, b: a / b if b else 0.0
    return {
        "n_words": n,
        "n_repeat_words": repeated,
        "symbol_share": share(symbols, chars),
        "upper_share": share(sum(unicodedata.category(c) == "Lu" for c in text), chars),
        "bang_share": share(text.count("!"), n),
        "bar_share": share(text.count("|"), n),
        "repeat_share": share(repeated, n),
        "dup_line_share": share(len(lines) - len(set(lines)), len(lines)),
        "mean_word": share(chars, n),
        "distinct_share": share(len(set(w)), n),
    }


def passes(text, rules):
    """Whether the base rule and the learned decision list keep a text."""
    f = features(text)
    if f["n_words"] < 10 or 100 * f["n_repeat_words"] > 20 * f["n_words"]:
        return False
    return not any(all((f[c.feature] > c.cut) == c.above for c in rule.conditions) for rule in rules)


def redacted(text):
    out, at = [], 0
    for start, end in sorted((s["start"], s["end"]) for rule in secrets.RULES for s in secrets.spans(rule, text)):
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def dealt(rows, cycle=mixing.CYCLE, most=mixing.MOST):
    """Brute force: size, source_size, target, and sorted (taken, copies) of the equal rows of each (id, source, text)."""
    rows = [(i, t or "", s, len(WORD.findall(t or ""))) for i, t, s in rows]
    names = sorted({s for _, _, s, _ in rows if s is not None}) + [None] * any(s is None for _, _, s, _ in rows)
    size = {s: sum(n for *_, x, n in rows if x == s) for s in names}
    weight = {s: cycle[k % len(cycle)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(size.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * size[s]}
        for s in over or open_:
            target[s] = most * size[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ -= over or open_

    def key(i, t):
        digest = hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}:{t}".encode()).hexdigest()
        lines = [x for x in t.split("\n") if WORD.search(x)]
        n = max(1, len(t))
        w = max(0.1, (1 - 4 * len(re.findall(r"[#*$%&|<>]", t)) / n) * (1 - sum(c.isupper() for c in t) / n) * (len(set(lines)) / max(1, len(lines))))
        return -math.log((int(digest[:13], 16) + 1) / (2**52 + 1)) / w, digest, -1 if i is None else i

    out = collections.defaultdict(list)
    for s in names:
        epochs = int(round(target[s], 6) // size[s]) if size[s] else 0
        rest = round(target[s]) - epochs * size[s]
        for i, t, _, n in sorted((r for r in rows if r[2] == s), key=lambda r: key(r[0], r[1])):
            part = max(0, min(n, rest))
            rest -= part
            out[i, s, t].append((epochs * n + part, epochs + (part > 0 and 2 * part >= n)))
    return {k: sorted(v) for k, v in out.items()}
