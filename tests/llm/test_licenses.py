import re

from pyspark.sql import functions as F

from ledgerkeep.llm import licenses as lc

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for p, label in lc.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    found = set()
    for line in re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split("\n"):
        block = set(re.findall(WORD, line))
        for label, template in lc.TEMPLATES.items():
            wanted = set(re.findall(WORD, template.lower()))
            if len(wanted & block) >= lc.THRESHOLD * len(wanted) - 1e-9:
                found.add((label, len(wanted & block) / len(wanted)))
    base = sorted({label for _, label in at})
    score = 1.0 if at else max((c for _, c in found), default=0.0)
    return len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(base), ",".join(sorted({*base, *(f[0] for f in found)})), round(score, 9)


TEXTS = [
    "Released under the MIT License.", "mit\nlicense", "MIT-License, the mit license! Apache   License", "submit license", None, "", "ÉMIT license mit licenseé",
    "Permission is granted, free of charge, to any person obtaining a copy of this software and associated documentation files now",
    "You may redistribute it under the terms of the GNU General Public License; this program is free software: you can modify and or it",
    "general public license general public license", "rights all reserved\nall rights\nreserved", "CC 4 BY 0 NC licensed", "no words here at all", "x mit license " * 3000,
]


def test_scan_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, score int, labels string")
    rows = {r.doc_id: r for r in lc.scan(df).collect()}
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) == brute(t), t


def test_filters_lose_no_match():
    import random

    rng = random.Random(5)
    vocabulary = [f"v{i}".encode() for i in range(30)]
    for threshold in (0.3, 0.5, 0.8, 1.0):
        templates = {f"t{i}": " ".join(w.decode() for w in rng.sample(vocabulary, rng.randint(1, 12))) for i in range(15)}
        index = lc.Index(templates, {w: rng.randint(0, 9) for w in vocabulary}, threshold)
        for _ in range(200):
            block = set(rng.sample(vocabulary, rng.randint(0, 20)))
            expected = []
            for label, text in templates.items():
                wanted = set(text.encode().split())
                if len(wanted & block) >= threshold * len(wanted) - 1e-9:
                    expected.append((label, len(wanted & block) / len(wanted)))
            assert sorted(index.matches(block)) == sorted(expected)


def test_frequencies_cover_all_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "mit MIT x"), (1, "mit"), (None, None)], "doc_id long, text string")
    assert lc.frequencies(df, {b"mit", b"other"}) == {b"mit": 3}
    assert len(lc.scan(df).collect()) == 3
    assert lc.scan(df.where(F.lit(False))).collect() == []


def test_wrapped_notices_are_found_and_scattered_words_are_not(spark):
    notice = lc.TEMPLATES["mit-notice"].split()
    wrapped = "Some title\n\n" + "\n".join("// " + " ".join(notice[i : i + 5]) for i in range(0, len(notice), 5)) + "\nrest of it"
    filler = " ".join(f"w{i}" for i in range(40))
    scattered = f" {filler} ".join("Licensed under CC BY NC 4 0 all rights reserved".split())
    texts = [wrapped, scattered, f"{filler} {scattered} all\nrights reserved", "All rights reserved.\nx y z\nAll rights reserved."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score, [(b.label, b.line) for b in r.blocks]) for r in lc.scan(df).collect()}
    assert got[0] == ("mit-notice", 1.0, [("mit-notice", 2)])
    assert got[1] == ("", 0.0, [])
    assert got[2] == ("all-rights-reserved", 1.0, [("all-rights-reserved", 0)])
    assert got[3] == ("all-rights-reserved", 1.0, [("all-rights-reserved", 0), ("all-rights-reserved", 2)])


def test_windows_equal_brute_force():
    import random

    rng = random.Random(9)
    vocabulary = [f"v{i}".encode() for i in range(14)]
    for threshold in (0.5, 0.8, 1.0):
        templates = {f"t{i}": " ".join(w.decode() for w in rng.choices(vocabulary, k=rng.randint(1, 9))) for i in range(8)}
        index = lc.Index(templates, {}, threshold)
        for _ in range(150):
            text = rng.choices(vocabulary + [b"x"] * 10, k=rng.randint(0, 60))
            expected = {}
            for label, t in templates.items():
                wanted, span = set(t.encode().split()), -int(-len(t.split()) / threshold // 1)
                best = max((len(wanted & set(text[i : i + span])) / len(wanted) for i in range(len(text))), default=0)
                if best >= threshold - 1e-9:
                    expected[label] = best
            got = {}
            for _, label, c in index.windows(text):
                got[label] = max(c, got.get(label, 0))
            assert got == expected
