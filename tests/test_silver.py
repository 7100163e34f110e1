import datetime

import pytest
from pyspark.sql import functions as F

from pairloom.functions import text as T
from pairloom.operators import documents as D, selection as SE, silver as SI
from pairloom.sources.tables import source_schema


def posting(link, title="Harbour\t Pilot  ", seen="2023-11-02", done="2023-11-30 23:59:01+00:00"):
    fields = dict(
        job_link=link, last_processed_time=done, got_summary="f", got_ner="t", is_being_worked="maybe", job_title=title,
        company="  Tide &  Sons", job_location="Port\nLouis ", first_seen=seen, search_city="Curepipe",
        search_country="Mauritius", search_position="Pilot", job_level="Associate", job_type="Remote",
    )
    return tuple(fields[name] for name in source_schema("linkedin_job_postings").names)


def raw(spark, name, rows):
    return spark.createDataFrame(rows, source_schema(name))


def silver(spark, **options):
    return SI.silver_jobs(
        raw(spark, "linkedin_job_postings", [posting("dock/7"), posting("dock/8", "COOK", "31 May", "")]),
        raw(spark, "job_summary", [("dock/7", "Guides  ships\tInto port. ")]),
        raw(spark, "job_skills", [("dock/7", " Charts ,radio,, CHARTS,knots")]),
        **options,
    )


def test_postings_keep_raw_columns_and_gain_typed_ones(spark):
    rows = {row.job_link: row for row in silver(spark).collect()}
    one, two = rows["dock/7"], rows["dock/8"]
    assert one.job_title == "Harbour\t Pilot  " and one.job_title_normalized == "harbour pilot"
    assert one.company_normalized == "tide & sons" and one.job_location_normalized == "port louis"
    assert one.first_seen_date == datetime.date(2023, 11, 2)
    assert one.last_processed_at == datetime.datetime(2023, 11, 30, 23, 59, 1)
    assert (one.got_summary_flag, one.got_ner_flag) == (False, True)
    assert two.first_seen_date is None and two.last_processed_at is None


def test_enrichment_keeps_postings_without_children(spark):
    rows = {row.job_link: row for row in silver(spark).collect()}
    one, two = rows["dock/7"], rows["dock/8"]
    assert one.job_summary_normalized == "Guides ships Into port."
    assert one.skills == ["charts", "knots", "radio"] and one.skill_count == 3 and one.eligible_for_ml
    assert (two.has_summary, two.has_skills, two.skill_count, two.eligible_for_ml) == (False, False, 0, False)
    assert [row.skills_count_warning for row in silver(spark, skill_count_warning=1).orderBy("job_link").collect()] == [True, False]


def test_children_are_restricted_to_kept_parents(spark):
    kept = raw(spark, "linkedin_job_postings", [posting("dock/7"), posting("dock/9")])
    texts = raw(spark, "job_summary", [("quay/1", "x"), ("dock/9", "y"), ("quay/2", "z")])
    (only,) = SI.restrict_children(kept, texts)
    assert [row.job_link for row in only.collect()] == ["dock/9"]


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="Missing required columns: job_skills"):
        SI.typed_skills(spark.createDataFrame([("a",)], "job_link string"))


RESUMES = [
    (
        "Deck hand",
        "A Professional Resume for Mara Quill: Mara Quill. Write to m.quill+sea@tide.example, ring 415.555.0136, "
        "or look at linkedin.com/in/mara-quill today",
        " SELECT ", "Knows knots", "Sail the  evening ferry",
    ),
    ("Cook", "Ask b_stone@galley.example (1-808-555-0142) for Ben", "Reject", "No papers", "sail the evening Ferry "),
    ("Cook", "Nobody has looked at this", None, "", None),
]


def test_resumes_are_masked_labelled_and_split_by_group(spark):
    rows = SI.silver_resumes(raw(spark, "resume_screening", RESUMES)).collect()
    assert len({row.resume_id for row in rows}) == 3
    assert rows[0].job_description_id == rows[1].job_description_id and rows[0].split == rows[1].split
    assert [row.label for row in rows] == [1, 0, None]
    text = rows[0].resume_normalized
    for secret in ("tide.example", "555.0136", "mara", "quill", "linkedin.com"):
        assert secret not in text
    for token in ("[email]", "[phone]", "[linkedin]", "[name]: [name]"):
        assert token in text
    assert not any(row.pii_masking_warning for row in rows)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("call +1 617.555.1234 now", "call [PHONE] now"),
        ("(617)555-1234", "[PHONE]"),
        ("id 96175551234567", "id 96175551234567"),
        ("617-555-1234 212-555-9999", "[PHONE] [PHONE]"),
        ("A.B+c@x-y.org, d@e", "[EMAIL], d@e"),
        ("professional resume for Ann O'Neil-Wu: Ann O'Neil-Wu has", "professional resume for [NAME]: [NAME] has"),
        ("professional resume for Ann Wu: Bob Wu has", "professional resume for [NAME]: [NAME] Bob Wu has"),
    ],
)
def test_masks(spark, text, expected):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(T.mask_identifiers(F.col("t"))).first()[0] == expected


def test_documents_use_allowed_fields_only(spark):
    jobs = spark.createDataFrame(
        [("p", "harbour pilot", "guides ships", ["charts", "radio"]), ("q", "y", None, None), ("r", "", " ", [])],
        "job_link string, job_title_normalized string, job_summary_normalized string, skills array<string>",
    )
    resumes = spark.createDataFrame(
        [("s", "deck hand", "ropes and paint", "NOT FOR FEATURES", 0)],
        "resume_id string, role_normalized string, resume_normalized string, Job_Description string, label int",
    )
    texts = {row.source_id: row.combined_text for row in D.job_documents(jobs).collect()}
    assert texts == {"p": "harbour pilot guides ships charts radio", "q": "y"}
    document = D.resume_documents(resumes).first()
    assert document.combined_text == "deck hand ropes and paint" and document.document_type == "resume"
    assert D.job_documents(jobs).columns == D.CONTRACT


def test_evaluation_documents_drop_rows_without_description(spark):
    resumes = SI.silver_resumes(raw(spark, "resume_screening", RESUMES))
    rows = D.evaluation_documents(resumes).collect()
    assert len(rows) == 2 and {row.combined_text for row in rows} == {"sail the evening ferry"}
    assert len({row.document_id for row in rows}) == 2


@pytest.mark.parametrize("method", ["xxhash64", "sha256"])
def test_samples_are_repeatable_and_nested(spark, method):
    frame = spark.range(2000).select(F.concat(F.lit("job-"), "id").alias("k"))

    def keys(fraction):
        return {row.k for row in SE.hash_sample(frame, "k", fraction, 5110, method=method).collect()}

    small, large = keys(0.1), keys(0.3)
    assert small == keys(0.1) and small < large and 120 < len(small) < 280 and 500 < len(large) < 700
    assert len(keys(1)) == 2000
    for fraction in (0, 1.5):
        with pytest.raises(ValueError, match="fraction"):
            SE.hash_sample(frame, "k", fraction, 5110)
    with pytest.raises(ValueError, match="to sample by"):
        SE.hash_sample(frame, "nope", 0.5, 5110)


def test_split_never_divides_a_group(spark):
    frame = spark.range(3000).select((F.col("id") % 300).cast("string").alias("g"))
    rows = SE.group_split(frame, "g", 5110, 0.7, 0.15).distinct().collect()
    assert len(rows) == 300
    shares = {name: sum(row.split == name for row in rows) / 300 for name in SE.SPLITS}
    assert 0.6 < shares["train"] < 0.8 and 0.08 < shares["test"] < 0.25


def test_select_queries_takes_lowest_keys_of_a_split(spark):
    rows = [("m", "train"), ("d", "test"), ("k", "train"), ("a", "test"), ("c", "train")]
    frame = spark.createDataFrame(rows, "k string, split string")
    assert [row.k for row in SE.select_queries(frame, "k", "train", 2).collect()] == ["c", "k"]
    assert [row.k for row in SE.select_queries(frame, "k", "all", 3).collect()] == ["a", "c", "d"]
    assert sorted(row.k for row in SE.select_queries(frame, "k", "test").collect()) == ["a", "d"]
    with pytest.raises(ValueError, match="split"):
        SE.select_queries(frame, "k", "other", 1)
    with pytest.raises(ValueError, match="limit"):
        SE.select_queries(frame, "k", "all", 0)


def test_diverse_pick_prefers_new_groups_then_repeats(spark):
    frame = spark.createDataFrame(
        [("r1", "engineer"), ("r2", " engineer "), ("r3", "nurse"), ("r4", None), ("r5", "")], "k string, role string"
    )
    two_of = SE.pick_diverse(frame, "k", "role", 3, 5110).collect()
    assert {row.role for row in two_of} == {"engineer", "nurse", "unknown"}
    everything = SE.pick_diverse(frame, "k", "role", 9, 5110).orderBy("pick").collect()
    assert [row.pick for row in everything] == [1, 2, 3, 4, 5] and len({row.k for row in everything}) == 5
    assert {row.role for row in everything[:3]} == {"engineer", "nurse", "unknown"}


def test_parse_list_and_buckets(spark):
    frame = spark.createDataFrame([("b|a.c| A.C ||b",), (None,)], "t string")
    assert [row[0] for row in frame.select(T.parse_list(F.col("t"), "|")).collect()] == [["a.c", "b"], []]
    counts = spark.createDataFrame([(n,) for n in (0, 99, 100, 249, 250, 499, 500, 999, 1000)], "n int")
    names = [row[0] for row in counts.select(T.length_bucket(F.col("n"))).collect()]
    assert names == ["<100", "<100", "100-249", "100-249", "250-499", "250-499", "500-999", "500-999", "1000+"]


def test_tokens_keep_technical_names(spark):
    frame = spark.createDataFrame([("The C++ and C# of Node.js, r: python. ÉTÉ it's",)], "t string")
    words = frame.select(T.tokens(F.col("t"))).first()[0]
    assert words == ["c++", "c#", "node.js", "python.", "été"]


def test_stop_words_equal_the_remover_list(spark):
    from pyspark.ml.feature import StopWordsRemover

    from pairloom.functions.stopwords import ENGLISH_STOP_WORDS

    assert ENGLISH_STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")
