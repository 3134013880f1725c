"""Texts of other languages and random letters are rejected at every length, clean ones are not."""

import random

from textloom.llm import langid
from textloom.storage import table


def test_long_foreign_and_random_texts(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    model, rng = langid.fit(docs), random.Random(1)
    letters = lambda n: " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=6)) for _ in range(n))
    foreign = {
        "ru": "Мы живём в большом городе, где каждый день происходит что-нибудь новое и интересное, и поэтому скучать нам никогда не приходится. " * 2,
        "el": "Η γλώσσα είναι ένα σύστημα επικοινωνίας που χρησιμοποιούν οι άνθρωποι κάθε μέρα. " * 3,
        "ja": "日本語の文章はひらがなとカタカナと漢字で書かれています。今日は天気がとても良いです。" * 4,
        "ar": "هذا نص عربي طويل يتحدث عن الطقس والحياة في المدينة الكبيرة " * 20,
        "han": "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(300)),
        "mash": "asdf jkl qwer uiop zxcv nm asdfjkl qweruiop fghj tyui vbnm sdfg hjkl wert yuio xcvb asdf lkjh poiu rewq mnbv cxz",
        "20": letters(20),
        "200": letters(200),
    }
    assert {k for k, t in foreign.items() if not model.predict(t)[2]} == set()
    rows = [r.text for r in docs.where("doc_id % 20 = 0").collect()]
    assert sum(model.predict(t)[2] for t in rows) <= 1
    short = [" ".join(t.split()[:n]) for t in rows for n in (1, 2)]
    assert sum(model.predict(t)[2] for t in short) <= 0.02 * len(short)
