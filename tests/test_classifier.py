"""The trained model on texts it has not seen."""

from brandsieve.operators.classifier import MacroF1, add_prediction, train_classifier
from brandsieve.operators.training import add_class_weight

TRADES = ["bakery", "garage", "florist", "laundry", "school", "clinic", "hotel", "farm"]
PLACES = ["village", "harbour", "station", "market", "campus", "valley"]
NOISE = ["qxzt", "vbnm", "wqrt", "zzkp", "plkj", "mnbv", "trwq", "kjhg"]


def examples(shift):
    """Sentences of two kinds; another shift joins other trades with other places."""
    out = []
    for i in range(48):
        out.append((f"A friendly {TRADES[i % 8]} near the {PLACES[(i + shift) % 6]} for guests of all ages", 1))
        out.append((" ".join(NOISE[(i + k * (k + shift)) % 8] for k in range(6)), 0))
    return out


def test_learns_and_predicts_unseen_texts(spark):
    train = examples(0)
    test = [x for x in examples(1) if x not in train]
    assert {y for _, y in test} == {0, 1}
    df = add_class_weight(spark.createDataFrame(train, "text string, label int"))
    model = train_classifier(df, "text", features=1 << 12, regularisation=(0.01,))
    scored = add_prediction(spark.createDataFrame([*test, (None, 1)], "text string, label int"), model, "text")
    rows = scored.collect()
    for row in rows[:-1]:
        assert row["result"]["confidence"] == max(row["result"]["probabilities"])
        assert abs(sum(row["result"]["probabilities"]) - 1) < 1e-9
    counted = scored.where("text IS NOT NULL").selectExpr("label", "CAST(result.is_legitimate AS INT) AS prediction")
    assert MacroF1().evaluate(counted) > 0.95
    failed = rows[-1]["result"]
    assert (failed["is_legitimate"], failed["confidence"], failed["error"]) == (True, 0.5, "missing text")
