"""Small tables with every awkward case."""

import random

WORDS = [a + b for a in ("ba", "no", "ti", "ré", "sch", "lo") for b in ("ka", "mi", "ur", "enß", "a", "st")]
#: Extra columns whose names the operators use themselves.
CLASHES = "g string, cls int, n string, tokens string, size string, label int, k string, kept string, n_units string, taken string, target string, held_out int"
CLASH_VALUES = ("g", 1, "n", "t", "s", 2, "k", "kept", "u", "x", "t", 3)


def sentence(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n)).capitalize() + "."


def prose(draw, n):
    out = []
    while n > 0:
        k = min(n, draw.randint(4, 14))
        out.append(sentence(draw, k) + ("\n" if draw.random() < 0.2 else ""))
        n -= k
    return " ".join(out)


def documents(seed=1, n=60):
    """(doc_id, text, lang, source, n_chars) rows: prose, copies, near copies, nulls, empties, a long one."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append([i, prose(draw, draw.randint(5, 200)), "en", f"src{i % 4}"])
    for i in range(n, n + 15):  # near copies of one text, some of them of one another only
        words = rows[0][1].split(" ") if i % 2 else rows[i - 1][1].split(" ")
        for _ in range(draw.randint(0, 4)):
            words[draw.randrange(len(words))] = draw.choice(WORDS)
        rows.append([i, " ".join(words), "en", "src0"])
    rows += [[n + 20 + i, rows[3][1], "fr", "src1"] for i in range(6)]  # copies
    rows += [
        [n + 30, None, None, None], [n + 31, "", "en", ""], [n + 32, " \n\t ", "en", "src1"], [n + 33, "one two", "en", None], [n + 34, "ONE two", "en", "src2"],
        [n + 35, "a b c d e", "en", "src2"], [n + 36, prose(draw, 6000), "en", "src3"], [n + 37, "x" * 50_000, "en", "src3"], [n + 38, "no end " * 400, "en", "src3"],
        [None, rows[5][1], "en", "src1"], [n + 39, rows[6][1], "en", "src2"], [n + 39, rows[6][1], "en", "src2"], [n + 40, rows[7][1].upper(), "en", "src2"],
        [n + 41, "İstanbul ﬁn\x1c\x00  end", "tr", "src2"],
    ]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None, clashes=False, parts=5):
    rows = documents() if rows is None else rows
    if clashes:
        return spark.createDataFrame([(*r, *CLASH_VALUES) for r in rows], f"{COLUMNS}, {CLASHES}").repartition(parts)
    return spark.createDataFrame(rows, COLUMNS).repartition(parts)
