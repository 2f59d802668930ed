import random
import re

from pyspark.sql import functions as F

from ledgerkeep.llm import line_dedup as ld

PASSAGE = "This passage has more than six words in it. And this one here has also got more than six words!"
ROWS = [
    (3, f"Some start of its own here, for sure. {PASSAGE} End."), (1, PASSAGE.upper().replace(" ", "  ")), (2, None), (4, ""), (None, PASSAGE), (5, "Short one. Short one."),
    (6, "Long enough sentence that comes twice inside it.\nLong enough sentence that comes twice inside it."), (7, "é" * 3 + " ß, a b c d e f g h. " * 2), (8, PASSAGE), (8, PASSAGE),
]


def table(spark):
    return spark.createDataFrame([(*r, "b", 9) for r in ROWS], "doc_id long, text string, begin string, removed int")


def brute(rows, unit="sentence", least=ld.LEAST_WORDS):
    """(position of the row, begin, end) of all units to remove."""
    seen, out = set(), set()
    for i, (_, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        for m in re.finditer(ld.UNITS[unit], text or ""):
            plain = re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[A-Z]", lambda c: c[0].lower(), m.group())).strip(" ")
            if plain and len(plain.split(" ")) >= least:
                if plain in seen:
                    out.add((i, m.start(), m.end()))
                seen.add(plain)
    return out


def test_repeats_equal_brute_force(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "row long, doc_id long, text string").repartition(4)
    for unit in ld.UNITS:
        assert {(r.row, r.begin, r.end) for r in ld.repeats(df, unit).collect()} == brute(ROWS, unit)


def test_texts_lose_their_repeats_and_keep_the_offsets(spark):
    rows = ld.deduplicate(table(spark)).collect()
    assert len(rows) == len(ROWS)
    expected = []
    for i, (doc_id, text) in enumerate(ROWS):
        cuts = sorted((b, e) for r, b, e in brute(ROWS) if r == i)
        left, at = "", 0
        for b, e in cuts:
            left, at = left + (text or "")[at:b], e
        expected.append((doc_id, text if not cuts else left + text[at:], tuple(cuts)))
    assert sorted(((r.doc_id, r.text, tuple((x.begin, x.end) for x in r.removed)) for r in rows), key=str) == sorted(expected, key=str)


def test_empty_table(spark):
    none = table(spark).where(F.lit(False))
    assert ld.deduplicate(none).collect() == []
    assert ld.repeats(none.withColumn("row", F.lit(1).cast("long"))).collect() == []


def test_passages_with_short_sentences_go_whole(spark):
    short = "Of it. Of them. Of us. Of you."
    first = "A long enough sentence that opens the passage. Short one. And another long sentence that ends it here."
    rows = [
        (1, f"{short}\n{first}"), (2, f"Own words stand here before all that.\n{short.upper()}\n"), (3, f"Own start. {first} Own end."),
        (4, first.replace("Short one", "Another one")), (5, short.replace("you", "me")), (6, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row long, doc_id long, text string").repartition(4)
    gone = {d: [False] * len(t or "") for d, t in rows}
    for r in ld.passages(df).collect():
        assert (r.kept_doc_id, r.kept_begin) < (r.doc_id, r.begin)
        gone[r.doc_id][r.begin : r.end] = [True] * (r.end - r.begin)
    left = {d: "".join(c for c, g in zip(t or "", gone[d]) if not g) for d, t in rows}
    assert left == {1: rows[0][1], 2: "Own words stand here before all that.\n", 3: "Own start. Own end.", 4: " Another one.", 5: rows[4][1], 6: ""}
    assert ld.passages(df.where(F.lit(False))).collect() == []


def brute_passages(rows, least=ld.LEAST_WORDS):
    """(position of the row, begin, end) of all lines, sentences and gaps to remove, from each text's list of sentences."""

    def words(s):
        return tuple(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), s)))

    seen, out = {}, set()

    def meet(i, begin, end, key):
        if seen.setdefault(key, (i, begin)) != (i, begin):  # the only sentence of a line that stays is not a repeat of it
            out.add((i, begin, end))

    for i, (_, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        parts, found = [], []  # (begin, end, words, whether long) in order; what is compared
        for line in re.finditer(ld.UNITS["line"], text or ""):
            if len(words(line.group())) < least:
                parts.append((line.start(), line.end(), words(line.group()), False))
                continue
            found.append((line.start(), 0, line.end(), ("unit", words(line.group()))))
            for m in re.finditer(ld.UNITS["sentence"], line.group()):
                own = (line.start() + m.start(), line.start() + m.end(), words(m.group()), len(words(m.group())) >= least)
                parts.append(own)
                if own[3] and own[:2] != line.span():
                    found.append((own[0], 1, own[1], ("unit", own[2])))
        long = [k for k, p in enumerate(parts) if p[3]]
        for a, b in zip(long, long[1:]):
            between = sum((p[2] for p in parts[a + 1 : b]), ())
            if between:
                found.append((parts[a][1], 2, parts[b][0], ("gap", parts[a][2], between, parts[b][2])))
        for begin, _, end, key in sorted(found, key=lambda f: (f[0], f[1])):
            meet(i, begin, end, key)
    return out


def test_passages_equal_brute_force(spark):
    rng = random.Random(6)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n)) + rng.choice(".!?") for n in (1, 2, 3, 5, 6, 7, 9, 12) for _ in range(3)]
    texts = ["".join(rng.choice(pool).title() + rng.choice([" ", " ", "\n", "  \n\n"]) for _ in range(rng.randint(0, 9))) for _ in range(70)]
    texts += [None, "", texts[3], texts[3], "word " * 3000 + ". " + "word " * 3000]
    rows = [(rng.choice([None, k // 2, k]), t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(i, *r, "x", 1, 2) for i, r in enumerate(rows)], "row long, doc_id long, text string, digest string, begin int, kept_begin int").repartition(4)
    found = [(r.row, r.begin, r.end) for r in ld.passages(df).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_passages(rows) and len(found) > 50
