"""G4: reply parsing; prompts; fallback picks; log rows (RR1–RR5, SRT4, SNK5)."""

from pyspark.sql import functions as F

from pawgrid.operators import rerank as R

G4 = "\n".join(["추천 리스트:", "1. 이름: 콩이", "   이유: 순하다", "2. 이름: 보리", "3. 초코", "   이유: 무시됨",
                "5. 이름: 달", "   이유: 첫째", "6. 이름: 별", "   이유: 덮어씀", "10. 이름: 해"])


def test_g4_parse(spark):
    rep = spark.createDataFrame([(1, G4), (2, "아무것도 없음")], "qid long, reply string")
    got = [(r.qid, r.item, r.name, r.reason) for r in R.parse_replies(rep).orderBy("qid", "item").collect()]
    assert got == [(1, 1, "콩이", "순하다"), (1, 2, "보리", None), (1, 3, "달", "덮어씀")]


def test_shown_and_fallback(spark):
    rep = spark.createDataFrame([(1, G4), (2, "")], "qid long, reply string")
    picks = R.parse_replies(rep)
    assert R.shown_picks(picks).count() == 2
    cands = spark.createDataFrame(
        [(q, r, 10 * q + r, n) for q in (1, 2) for r, n in enumerate(["콩이", "달", "x", "y", "z", "w"], 1)],
        "qid long, rank long, uid long, name string")
    fin = {(r.qid, r.pick_rank): (r.uid, r.source) for r in R.final_picks(picks, cands).collect()}
    assert fin[(1, 1)] == (11, "rerank") and fin[(1, 2)] == (None, "rerank") and fin[(1, 3)] == (12, "rerank")
    assert sorted(k for k in fin if k[0] == 2) == [(2, i) for i in range(1, 6)]
    assert all(v[1] == "similarity" for k, v in fin.items() if k[0] == 2)


def test_candidate_rows_keep_every_top_row(spark):
    top = spark.createDataFrame([(1, 1, 7, 0.5), (1, 2, 8, 0.4)], "qid long, rank long, uid long, similarity double")
    listings = spark.createDataFrame([(7, "콩이")], "uid long, addinfo01 string")
    got = {r.uid: (r.name, r.link) for r in R.candidate_rows(top, listings, "https://site.example/").collect()}
    assert got == {7: ("콩이", "https://site.example/7"), 8: (None, "https://site.example/8")}


def test_as_many_picks_as_asked(spark):
    text = "\n".join(f"{i}. 이름: n{i}" for i in range(1, 13))
    rep = spark.createDataFrame([(1, text)], "qid long, reply string")
    assert R.parse_replies(rep).count() == 5 and R.parse_replies(rep, picks=12).count() == 12


def test_whole_texts_unless_a_length_is_given(spark):
    c = spark.createDataFrame([("남", "3", "", "p" * 500, "", "s" * 400)],
                              "gender string, weight string, personality_tags string, personality_desc string, "
                              "special_needs string, rescue_story string")
    whole = R.with_candidate_text(c).first().description
    cut = R.with_candidate_text(c, personality_length=200, story_length=150).first().description
    assert "p" * 500 in whole and "s" * 400 in whole
    assert "p" * 200 + "..." in cut and "p" * 201 not in cut and "s" * 150 + "..." in cut and "s" * 151 not in cut


def test_prompt_layout(spark):
    cands = spark.createDataFrame([(1, 2, "b", "desc b", 0.5), (1, 1, "a", "desc a", 0.0625)],
                                  "qid long, rank long, name string, description string, similarity double")
    q = spark.createDataFrame([(1, "조용한 아이")], "qid long, text string")
    p = R.prompts(cands, q).first().prompt
    assert p.startswith('사용자 쿼리:\n"조용한 아이"\n\n아래는 추천 후보 동물 리스트입니다:\n1. 이름: a\n   설명: desc a')
    assert p.index("1. 이름: a") < p.index("2. 이름: b") and "유사도 점수: 0.500" in p
    assert p.endswith("3. ...\n")


def test_log_defaults(spark):
    picks = spark.createDataFrame([(1, 1, None, "r"), (1, 2, "n", None)], "qid long, item long, name string, reason string")
    q = spark.createDataFrame([(1, "질문")], "qid long, text string")
    rows = R.pick_log(picks, q, satisfaction=F.lit(4), ts=F.lit("t")).orderBy("rank").collect()
    assert [(r.animal_name, r.reason, r.satisfaction) for r in rows] == [("이름없음", "r", 4), ("n", "이유없음", 4)]
