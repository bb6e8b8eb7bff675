"""D3-D5, D9, D11 against Python's re on random texts."""

import random
import re

from pyspark.sql import functions as F

from quarry.functions import text as tx

PIECES = ["- item", "* star", "• dot", "1. one", "12. twelve", "3.x", "# Head", "## Sub", "plain", "  ", "\n", "\n\n",
          "```py\ncode\n```", "```\nx```", "é", "Ünï", "tab\t", "a,b;c!", "  - spaced", "１. wide", "　", "\r"]


def py_list_items(t):
    items = re.findall(r"^(?:[-*•]|\d+\.)\s*(.+)$", t, re.MULTILINE)
    return items or [p.strip() for p in t.split("\n\n") if p.strip()]


def py_sections(t):
    return [s.strip() for s in re.split(r"#+\s*|^\d+\.\s+", t, flags=re.MULTILINE) if s.strip()]


def py_code(t):
    blocks = re.findall(r"```(?:\w+)?\n(.*?)```", t, re.DOTALL)
    return (blocks[0] if blocks else t), re.sub(r"```.*?```", "", t, flags=re.DOTALL).strip()


def py_slug(d):
    name = re.sub(r"\s+", "_", re.sub(r"[^\w\s]", "", d.lower()))
    if len(name) > 30 and len(name.split("_")) > 3:
        name = "_".join(name.split("_")[:3])
    return name + ".py"


def py_clean(m):
    return re.sub(r"^コミットメッセージ[:：]\s*", "", m.strip("\"'`"))


def test_text_functions_match_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) + rng.choice([" ", "\n", ""]) for _ in range(rng.randint(0, 12)))
             for _ in range(400)]
    texts += ["\"コミットメッセージ：  fix`", "'''quoted'''", "`a`\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    t = F.col("t")
    rows = df.select("i", tx.list_items(t).alias("li"), tx.sections(t).alias("se"), tx.code_block(t).alias("cb"),
                     tx.outside_code(t).alias("oc"), tx.file_slug(t, F.lit("Python")).alias("fs"),
                     tx.clean_message(t).alias("cm")).orderBy("i").collect()
    for r in rows:
        s = texts[r.i]
        assert list(r.li) == py_list_items(s), s
        assert list(r.se) == py_sections(s), s
        assert (r.cb, r.oc) == py_code(s), s
        assert r.fs == py_slug(s), s
        assert r.cm == py_clean(s), s
