"""Template matching of seeded items against a matcher that compares every window of every pair."""

import random

import pytest
import regex

from selfspan.llm import decontam

random.seed(21)
WORDS = "the a train leaves at with and carries boxes of apples from to while friends buy sell for each how many are left in total after trip".split()
NAMES = ["Anna", "Bob", "Carla", "Dmitri", "Ödön"]
UNITS = ["km", "kg", "%"]


def tokens_of(text):
    """(plain, value) of the template's tokens."""
    s = text.translate(str.maketrans(dict.fromkeys(f"{decontam.MARK}⟦⟧", " ")))
    s = regex.sub(r"(\p{N}+(?:[.,:/]\p{N}+)*)", rf" {decontam.MARK}num⟦\1⟧ ", s)
    s = regex.sub(r"(\p{Lu}(?<=[\p{L},;⟧] \p{Lu})\p{L}*)", rf"{decontam.MARK}name⟦\1⟧", s).lower()
    s = regex.sub(rf"({decontam.MARK}num⟦[^⟧]*⟧ {{1,2}})((?:{decontam.UNITS})(?![\p{{L}}\p{{N}}])|[%$€£°])", rf"\1{decontam.MARK}unit⟦\2⟧", s)
    found = regex.findall(rf"{decontam.MARK}(?:num|name|unit)⟦[^⟧]*⟧|\p{{L}}+", s)
    return [(t.split("⟦")[0], t.split("⟦")[1][:-1]) if "⟦" in t else (t, t) for t in found]


def brute(docs, items, window=decontam.WINDOW):
    out = set()
    for item_id, item_text in items:
        item = tokens_of(item_text or "")
        size = min(window, len(item))
        if not size:
            continue
        spots = range(len(item) - size + 1)
        slotted = [[k for k in range(size) if item[a + k][0].startswith(decontam.MARK)] for a in spots]
        typed = [2 * len(s) <= size for s in slotted]
        for doc_id, doc_text in docs:
            doc = tokens_of(doc_text or "")
            if size < decontam.SHORT and len(doc) != size:
                continue
            rows = []
            for a in spots:
                for b in range(len(doc) - size + 1):
                    literal = all(item[a + k][1] == doc[b + k][1] for k in range(size))
                    template = typed[a] and all(item[a + k][0] == doc[b + k][0] for k in range(size))
                    if literal or template:
                        rows.append((a, b - a, literal, template, {(item[a + k], doc[b + k][1]) for k in slotted[a]}))
            torn = {}
            for offset in {r[1] for r in rows}:
                said = {}
                for r in rows:
                    if r[1] == offset and r[3]:
                        for key, value in r[4]:
                            said.setdefault(key, set()).add(value)
                torn[offset] = {k for k, v in said.items() if len(v) > 1}
            met = {}
            for a, offset, literal, _, slots in rows:
                sound = not any(k in torn[offset] for k, _ in slots)
                one = met.setdefault(a, [False, False])
                one[0] |= literal
                one[1] |= sound
            total, typed_total = len(spots), sum(typed)
            literal_hits, sounds, typed_sounds = sum(m[0] for m in met.values()), sum(m[1] for m in met.values()), sum(m[1] for a, m in met.items() if typed[a])
            reached = lambda n, of: n > 0 and n >= min(of, decontam.LEAST) and (n >= decontam.SHARE * of or n >= decontam.ENOUGH)
            if reached(sounds, total) or reached(typed_sounds, typed_total) or literal_hits >= max(decontam.ENOUGH, decontam.LEAST):
                out.add((doc_id, item_id, total, sum(m[0] or m[1] for m in met.values()), literal_hits))
    return out


def item_form(n):
    """Words with places for names, numbers and units."""
    return [random.choice(["{name}", "{num}", "{num} {unit}", None, None, None, None]) or random.choice(WORDS) for _ in range(n)]


def filled(form, consistent=True, values=None):
    values = {} if values is None else values
    out = []
    for k, part in enumerate(form):
        drawn = {"{name}": random.choice(NAMES), "{num}": str(random.randint(2, 40)), "{num} {unit}": f"{random.randint(2, 9)}.5 {random.choice(UNITS)}"}.get(part)
        out.append(part if drawn is None else values.setdefault((part, k % 3) if consistent else (part, k), drawn))
    return " ".join(out), values


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_equal_brute_force(spark, seed):
    random.seed(seed)
    noise = lambda n: " ".join(random.choice([*WORDS, *NAMES, "7", "12 km"]) for _ in range(n))
    forms = [item_form(n) for n in (2, 3, 5, 9, 14, 25, 40)]
    items, docs = [], []
    for i, form in enumerate(forms):
        text, values = filled(form)
        items.append((i, text))
        docs += [(10 * i, text), (10 * i + 1, noise(15) + " " + text + " " + noise(15)), (10 * i + 2, noise(9) + " " + filled(form)[0] + " " + noise(3)), (10 * i + 3, filled(form, consistent=False)[0] + " " + noise(8))]
        docs += [(10 * i + 4, noise(4) + " " + " ".join(text.split()[: len(text.split()) // 2]) + " " + noise(20)), (10 * i + 5, text.upper()), (10 * i + 6, noise(60))]
    items += [(90, None), (91, ""), (92, items[4][1])]
    docs += [(900, None), (901, ""), (902, "12 13 14"), (None, items[5][1])]
    got = decontam.leaks(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(hits > literal for _, _, _, hits, literal in want) and any(d % 10 == 2 for d, *_ in want if d is not None)
