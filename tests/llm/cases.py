"""Documents with everything that tends to break: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

WORDS = "the of and to in for with that house river stone green walk talk bright under over license mit released night".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice("aeiou") * r.randint(0, 2)) for _ in range(n))


def odd_texts():
    shared = prose(1, 60)
    return [
        None, "", " ", "\n\n", "a", "Ünïcode ñ ß 你好 😀", "12345 67", "..!?", prose(2, 30), prose(2, 30), shared + " tail one", prose(3, 20) + " " + shared, prose(4, 5000), "x" * 120, "x" * 120 + "y",
        "nul \x00 byte and \x1c separators " * 4, "nul \x00 byte and \x1c separators " * 4 + "z", "Released under the MIT License.", "word", "word word word word",
    ]


def odd_documents(spark):
    """Extra columns bear the names that operators use themselves."""
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}", len(t) if t else None, 0.5, i, "b", [i]) for i, t in enumerate(odd_texts())]
    rows.append((None, "no id", "en", "src0", 5, 0.5, 1, "b", [1]))
    rows.append((2, " ", "en", "src0", 1, 0.5, 2, "b", [2]))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, block int, fp string, spans array<int>").repartition(3)


def labels_for(spark, docs):
    return docs.selectExpr("doc_id", "1 AS quality", "CAST(doc_id % 4 = 0 AS INT) AS toxic")


def empty(df):
    return df.where("false")
