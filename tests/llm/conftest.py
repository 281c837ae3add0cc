import random
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[2])]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, row int, path string, kept boolean, fp long, _id int"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing column names."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("aeiounrstlé") for _ in range(r.randint(1, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage, base = line(60), line(150)
    near = base.split()
    near[70] = "changed"
    texts = [None, "", " \n\t ", "one", base, base, " ".join(near), line(40) + "\n" + passage + "\n" + line(5), passage + " " + line(12), line(9000),
             "x " * 300, "same line here\n" * 4 + line(30), "Ünï¢ödé ﬁ 😀 İ <|endoftext|> it's " + line(20), "# $ % | < > &" * 5, "A\x0bB\x0cC\r\nD  E" + line(14)]
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 2}" if k % 4 else None, len(t or ""), "h", k, "p", False, 1, 2) for k, t in enumerate(texts)]
    rows += [rows[4], (None, base, "en", "s1", 3, "h", 1, "p", True, 1, 2), (None, None, None, None, None, None, None, None, None, None, None)]
    rows += [(100 + k, line(r.randint(20, 80)), "de", "s1", 0, "h", 1, "p", True, 1, 2) for k in range(40)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
