import pytest

pytest.importorskip("cellweave.llm.queries")

from cellweave.llm import garbled  # noqa: E402

CLEAN = ["Lago Sottovà", "Col de la Cîmolet", "Bois des Vésignan", "Bois des Corbezin – Dessous", "Åsnäs", "Ñandurí", "Cabane 157²", "Œuvrine §114", "Chez l’Ancien…"]
#: Garbled by a pair of one-byte encodings -> as it was written.
ONE_BYTE = [
    ("Lago Sottov…", "Lago Sottovà"), ("Col de la CŒmolet", "Col de la Cîmolet"), ("Bois des VÈsignan", "Bois des Vésignan"), ("Bois des Corbezin û Dessous", "Bois des Corbezin – Dessous"),
    ("Bois des Corbezin ñ Dessous", "Bois des Corbezin – Dessous"), ("≈sn‰s", "Åsnäs"), ("╤andurφ", "Ñandurí"), ("Cabane 825▓", "Cabane 825²"),
]


def test_one_byte_pairs_are_found_by_the_words_of_other_names(spark):
    rows = [s for s in CLEAN for _ in range(12)] + [b for b, _ in ONE_BYTE]
    df = spark.createDataFrame(list(enumerate(rows)), "feature_id long, NAME string")
    got = {r.name: (r.restored, r.complete) for r in garbled.find(df).collect()}
    assert got == {b: (good, True) for b, good in ONE_BYTE}


def test_rare_words_stay(spark):
    names = ["Łąkowa Górna", "Åsnäs", "Ñandurí", "Озёрная", "Αλώνι", "Alp „Tür“", "Chez l’Ancien…", "Höhe ±5 m", "Wäsch\xa0Egg", "Col d’Âvre"]
    assert garbled.find(spark.createDataFrame(list(enumerate(names)), "feature_id long, NAME string")).count() == 0
