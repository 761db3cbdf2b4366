"""Small tables with every odd case, and plain versions of the contracts."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or return; a table may have them too.
CLASHES = ("rid", "id", "h", "sha", "p", "size", "shard", "slot", "kept", "keep", "spans", "leaks", "cls", "n", "start", "end", "bucket", "taken", "target", "lines", "ends", "gone", "quality_score", "held_out")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta of the and stone river cloud tree run walk fine old new".split()) + r.choice(["", "", "", ".", ","]) for _ in range(n))


def rows():
    base, passage = prose(1, 120), prose(2, 30)
    near = base.split()
    near[60] = "changed"
    out = [
        (1, base, "en", "b", 1),
        (2, base.replace(" ", "\n", 3), "en", "b", 1),
        (3, " ".join(near), "en", None, None),
        (4, None, None, None, None),
        (5, "", "en", "a", 0),
        (6, " \t\n\x0b\f\r", "en", "a", 6),
        (7, "one", "en", "a", 3),
        (8, "One", "de", "a", 3),
        (9, passage + " " + prose(3, 40), "en", "ä", 9),
        (10, prose(4, 25) + " " + passage, "en", "b", 9),
        (11, "x " * 300, "en", "b", 600),
        (12, prose(5, 30000), "en", "c", 9),
        (13, "höß ñandú 😀   nbsp em", "de", "c", 9),
        (14, base, "en", "b", 1),
        (14, base, "en", "b", 1),
        (15, "a\nb\nc\nd\ne\nf\ng\nh\ni", "en", "b", 1),
        (16, "zero\na\nb\nc\nd\ne\nf\ng\nh\ni\nend", "en", "b", 1),
        (None, "no id at all, but some words", "en", "b", 1),
        (-17, "negative id", "en", "b", 1),
    ]
    return out + [(100 + i, prose(50 + i, 12 + i), "en" if i % 2 else "fr", "bac"[i % 3], i) for i in range(20)]


def table(spark, data=None, clashes=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}) if clashes else df


def words(text):
    return WORD.findall(text or "")
