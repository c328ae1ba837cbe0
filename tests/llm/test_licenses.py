import random

from tidemark.llm import licenses as L
from tests.llm.frames import awkward, documents, empty


def brute(rows, wanted):
    out = []
    for doc, text in rows:
        w = L.words_of(text or "")
        places, labels, share = set(), set(), 0.0
        for t, template in enumerate(wanted):
            if template.phrase:
                found = {(t, s) for s in range(len(w)) if w[s:s + len(template.words)] == template.words}
                places |= found
                if found:
                    labels.add(template.label)
                    share = 1.0
                continue
            for s in range(0, len(w), L.STEP):
                common = len(template.tokens & set(w[s:s + L.BLOCK]))
                if common >= template.need:
                    labels.add(template.label)
                    share = max(share, common / len(template.tokens))
        base = sorted({wanted[t].label for t, _ in places})
        starts = [s for _, s in places]
        out.append((doc, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted(labels)), share))
    return sorted(out, key=str)


def got(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_random_texts_match_brute_force(spark):
    draw = random.Random(9)
    wanted = L.templates()
    words = sorted(set().union(*(t.tokens for t in wanted)))
    rows = []
    for i in range(150):
        text = [draw.choice(words) if draw.random() < 0.4 else f"x{draw.randrange(50)}" for _ in range(draw.randint(0, 300))]
        for template in draw.sample(wanted, 2):
            at = draw.randint(0, len(text))
            text[at:at] = [w for w in template.words if draw.random() < 0.9]
        rows.append((i, " ".join(text)))
    rows += [(900, "MIT\nLicense. mit-license! mitlicense"), (901, "the gnu general PUBLIC license general public license")]
    assert got(L.scan(documents(spark, rows))) == brute(rows, wanted)


def test_place_across_a_block_border(spark):
    rows = [(n, "w " * n + "apache license " + "w " * 100) for n in range(60, 132, 3)]
    assert got(L.scan(documents(spark, rows))) == brute(rows, L.templates())


def test_awkward_rows(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    assert got(L.scan(awkward(spark))) == brute(rows, L.templates())
    assert L.scan(empty(spark)).count() == 0


def test_other_templates(spark):
    wanted = L.templates(phrases=(("one two", "p"),), texts=(("a b c d e f g h i j", "q"),), share=0.5)
    rows = [(1, "a b c d e z"), (2, "a b c d z"), (3, "one two one two"), (4, None)]
    assert got(L.scan(documents(spark, rows), wanted)) == brute(rows, wanted)
