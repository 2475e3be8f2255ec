import random

import pytest

WORDS = "the of and river stone light winter garden market copper signal village bridge window letter forest island mirror valley engine".split()
TOXIC = "idiot scum moron".split()


@pytest.fixture(scope="session")
def corpus(spark):
    """documents with copies, shared passages, personal data, empty and null texts, a null id, repeated rows and extra columns."""
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    rows, labels = [], []
    passage = prose(70)
    for i in range(120):
        text = prose(rng.choice((1, 3, 4, 20, 60, 120, 200)))
        if i % 9 == 0:
            text = f"{prose(5)} {passage}\n{prose(8)}"
        if i % 10 == 1 and rows:
            text = rows[-1][1]
        if i % 10 == 2 and rows and rows[-2][1]:
            words = rows[-2][1].split()
            words[0] = "Changed"
            text = " ".join(words)
        if i % 7 == 3:
            text += f" {rng.choice(TOXIC)} you {rng.choice(TOXIC)}"
        if i % 13 == 4:
            text += f" write to secret{i % 2} anna.{i % 3}@mail.example.com or +49 170 555 12{i % 3}4, 10.0.0.{i}, 4111 1111 1111 1111"
        rows.append((i, text, "en" if i % 3 else "fr", None if i % 11 == 0 else f"s{i % 4}", len(text), "x"))
        if i % 2:
            labels.append((i, i % 2, int(i % 7 == 3)))
    rows += [(200, "", "en", "s1", 0, "x"), (201, None, None, "s2", None, None), (202, " \n\t", "en", "s1", 3, "x"), (None, prose(80), "en", "s1", 1, "x"), (None, rows[5][1], "en", "s1", 1, "x"), rows[6], rows[6], (203, "word " * 9000, "en", "s3", 45000, "x")]
    labels += [(None, 1, 1), (3, 0, 1), (1, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string")
    return {"rows": rows, "docs": docs.repartition(4).cache(), "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "empty": spark.createDataFrame([], docs.schema)}
