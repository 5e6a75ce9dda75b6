from lodestone.llm.personal_data import find_personal_data, sanitise


def test_a_name_beside_an_address_in_one_text_is_found(spark):
    texts = ["Ask Wenzeslaus for more at w.b@example.org today", *(f"common filler words number {k} follow here today for more" for k in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in find_personal_data(docs).collect()}
    assert "term:4:14" in got[0].split(",") and f"term:{texts[0].index('today')}" not in got[0]
    assert not any(got[k] for k in range(1, 41))
    clean = {r.doc_id: r.text for r in sanitise(docs).collect()}
    assert "Wenzeslaus" not in clean[0] and clean[0].endswith("today") and clean[1] == texts[1]
