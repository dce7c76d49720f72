"""Plain versions of what operators compute, and rows that are odd in every way."""

from __future__ import annotations

import re

ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "x " * 50_000 + "end"), (5, "same text"), (5, "same text"), (None, "no number"), (6, "12345 !?")]


def plain_hits(text, items, window=13):
    """Every window of every item tried at every place."""

    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    words, hit, found = split(text), set(), set()
    for item_id, item in items:
        w = split(item)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(item_id)
    return len(words), len(hit), sorted(str(x) for x in found)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                doubled = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
                if not 13 <= len(digits) <= 19 or sum(v // 10 + v % 10 for v in doubled) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def plain_shape(string):
    """Addresses and number groups are one shape each; of others runs of letters and digits count as one sign."""
    if re.search(r"@|[\[({<]at[\])}>]", string, re.IGNORECASE):
        return "@"
    if re.fullmatch(r"[0-9\x20().+-]+", string) and not re.fullmatch(r"[0-9]+(\.[0-9]+)+", string):
        return "#"
    return re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", string))


def plain_sure(places, min_known=4, min_share=0.9, min_sure=0.9):
    """The rounds over patterns and strings, one after the other: {string: kind} of what is found."""
    contexts = {}
    for kind, string, before, after in places:
        if before or after:
            contexts.setdefault((string, before, after), set()).add(kind)
    edges = []
    for (string, before, after), kinds in contexts.items():
        form = plain_shape(string)
        known = min((k for k in kinds if k is not None), default=None)
        for words in (("b", before), ("a", after), ("c", before, after)):
            edges.append(((words, form), (before, after), string, known))
    found = {}
    while True:
        held, strings, stands, beside = {}, {}, {}, {}
        for pattern, _, string, kind in edges:
            strings.setdefault(pattern, set()).add(string)
            kind = kind if kind is not None else found.get(string)
            if kind is not None:
                held.setdefault(pattern, {}).setdefault(string, set()).add(kind)
        for pattern, context, string, kind in edges:
            if kind is None:
                stands.setdefault(string, set()).add(context)
        held = {p: {x: min(k) for x, k in h.items()} for p, h in held.items()}
        for pattern, h in held.items():
            for x, k in h.items():
                beside.setdefault(pattern[0], set()).add((x, k))
        able = {}
        for pattern, h in held.items():
            of = min(set(h.values()), key=lambda k: (-list(h.values()).count(k), k))
            most = list(h.values()).count(of)
            other = sum(k != of for _, k in beside[pattern[0]])
            plain = most / len(strings[pattern])
            if most >= min_known and (most >= min_share * (most + other) or plain >= min_share):
                able[pattern] = (of, most, other, plain, len(strings[pattern]) - len(h) > most)
        met = [(p, c, x) for p, c, x, k in edges if k is None and x not in found and p in able]
        inside = {}
        for p, c, x in met:
            inside.setdefault((x, able[p][0]), set()).add(c)
        against = {}
        for p, _, x in met:
            if 2 * len(inside[x, able[p][0]]) < len(stands[x]):
                against.setdefault(p, set()).add(x)
        doubt = {}
        for p, (_, most, other, plain, _) in able.items():
            share = max(most / (most + other + len(against.get(p, ()))), plain)
            if share >= min_share:
                doubt[p] = 1 - share * 0.99
        seen, once = {}, {}
        for p, c, x in met:
            if p in doubt:
                seen.setdefault((x, able[p][0]), set()).add(c)
                once.setdefault((x, able[p][0]), set()).add(p)
        sure = {}
        for (x, of), patterns in once.items():
            rest = 1.0
            for p in patterns:
                if not able[p][4] or len(seen[x, of]) >= 2:
                    rest *= doubt[p]
            sure.setdefault(x, []).append((1 - rest, -of))
        new = {x: -max(s)[1] for x, s in sure.items() if max(s)[0] >= min_sure}
        if not new:
            return found
        found |= new
