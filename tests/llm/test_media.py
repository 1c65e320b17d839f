"""Features of media: equal for equal texts, alike for near copies, whole for very long texts."""

import random

from twinloom.llm import media
from twinloom.llm.common import written


def of(text):
    return media.feature(*media.fingerprint(media.payload(text)))


def test_features_compare():
    r = random.Random(1)
    words = ["".join(r.choice("aehinorst") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    text = " ".join(words[:1500])
    near, far = text[: len(text) * 9 // 10] + " ".join(words[1500:1600]), " ".join(words[1500:])
    assert media.likeness(of(text), of(text)) == 1 and of(text) == of(text + " " * (-len(text) % 192))
    assert media.likeness(of(text), of(near)) > 0.5 > 0.1 > media.likeness(of(text), of(far))
    assert len({of(" ".join(r.sample(words, 12))) for _ in range(200)}) == 200
    assert media.likeness(of(""), of("")) == 1


def test_stored_and_read_back(spark):
    texts = ["", None, "a b c", "Ünï " * 400_000, "same", "same"]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, feature string, media string")
    stored = written(media.encode_media(docs), "media")
    got = {x["doc_id"]: x for x in media.read_media(stored, arrays=False).collect()}
    assert stored.columns == ["doc_id", "n_bytes", "media"] and [got[i]["feature"] for i in range(6)] == [of(t) for t in texts]
    assert got[0]["feature"] == got[1]["feature"] != got[2]["feature"] and got[4]["media_sha256"] == got[5]["media_sha256"] and got[3]["n_bytes"] == 2_400_000
