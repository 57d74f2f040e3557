"""Dataset builders on tiny hand-made raw files."""

import pytest

from cohortry.sources import datasets as D


def put(root, name, text):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text, encoding="utf-8")


@pytest.fixture(scope="module")
def base(tmp_path_factory):
    r = tmp_path_factory.mktemp("raw")
    put(r, "heart+disease/processed.cleveland.data", "63.0,1.0,1.0,145.0,233.0,1.0,2.0,150.0,0.0,2.3,3.0,?,6.0,0\n67,1,4,160,286,0,2,108,1,1.5,2,3.0,3.0,2\n37,1,3,130,250,0,0,187,0,3.5,3,1.0,3.0,0\n")
    put(r, "heart+disease/processed.va.data", "63,1,4,140,260,0,1,112,1,3,2,?,?,2\n")
    put(r, "breast+cancer+wisconsin+diagnostic/wdbc.data", "842302,M," + ",".join(["1.5"] * 30) + "\n7,B," + ",".join(["2"] * 30) + "\n")
    put(r, "hepatitis/hepatitis.data", "2," + ",".join(["1"] * 19) + "\n1,?," + ",".join(["3"] * 18) + "\n")
    put(r, "dermatology/dermatology.data", "2,2,0,55,2\n3,3,3,?,1\n")
    put(r, "thyroid+disease/new-thyroid.data", "1,107,10.1,2.2,0.9,2.7\n3,NA,9.9,?,1.0,2.9\n")
    put(r, "Medical Appointments No-Show.csv", "PatientId,Gender,ScheduledDay,AppointmentDay,Age,No-show\n11,M,2016-04-29T18:38:08Z,2016-04-29T00:00:00Z,62,No\n12,F,2016-04-27T08:36:51Z,2016-05-02T00:00:00Z,56,Yes\n")
    put(r, "covid_19_symptoms_survey.csv", "Fever,Dry Cough,Contact\nYes,Yes,far\nNo,Yes,near\n")
    put(r, "medical_questions_pairs.csv", '1,"What is a heart attack?","What is angina, really?",1\nx,Hello there, hello  you ,0\n')
    head = "\turlDrugName\trating\teffectiveness\tsideEffects\tcondition\tbenefitsReview\tsideEffectsReview\tcommentsReview\n"
    put(r, "drug+review+dataset+druglib/drugLibTrain_raw.tsv", head + "1\tMetformin \t8\tHighly Effective\tMild Side Effects\tdiabetes\tgood  one\tnone\t\n2\tx\tbad\tIneffective\tNo Side Effects\ty\ta\tb\tc\n")
    put(r, "drug+review+dataset+druglib/drugLibTest_raw.tsv", head + "3\tother\t2\t?\tSevere Side Effects\t\ta b c\td\te f\n")
    put(r, "isic_skin_cancer_sample/Train/melanoma/a.jpg", "x")
    put(r, "isic_skin_cancer_sample/Test/nevus/b.jpg", "x")
    put(r, "diabetes+130-us+hospitals+for+years+1999-2008/diabetic_data.csv",
        "patient_nbr,race,gender,age,admission_type_id,discharge_disposition_id,admission_source_id,time_in_hospital,num_lab_procedures,num_procedures,num_medications,number_outpatient,number_emergency,number_inpatient,number_diagnoses,readmitted\n"
        "5,Caucasian,Male,[50-60),1,2,7,3,4,5,6,0,0,1,9,NO\n6,Martian,Female,[60-70),3,2,7,1,4,5,6,0,0,1,9,<30\n")
    put(r, "diabetes+130-us+hospitals+for+years+1999-2008/IDS_mapping.csv", "admission_type_id,description\n1,Emergency\n,\ndischarge_disposition_id,description\n2,NULL\n")
    put(r, "Synthea Synthetic/patients.csv", "Id,BIRTHDATE,DEATHDATE,RACE,ETHNICITY,GENDER,ZIP,CITY,STATE,MARITAL\np1,1950-01-01,,white,hispanic,M,1,a,b,M\np2,1960-06-01,2020-01-01,,nonhispanic,F,2,c,d,S\n")
    put(r, "Synthea Synthetic/encounters.csv", "PATIENT,START,STOP,ENCOUNTERCLASS\np1,2010-01-01T00:00:00Z,2010-01-01T12:00:00Z,emergency\np1,2012-01-01T00:00:00Z,2012-01-02T00:00:00Z,wellness\n")
    put(r, "Synthea Synthetic/conditions.csv", "PATIENT,START,STOP,CODE,DESCRIPTION\np1,2010-01-01,,44,Heart failure\np1,2011-01-01,2011-02-01,55,Asthma\np1,2011-03-01,,44,Heart failure\n")
    put(r, "Synthea Synthetic/medications.csv", "PATIENT,START,STOP,CODE,DESCRIPTION\np1,2010-01-02,,9,Aspirin\n")
    put(r, "Synthea Synthetic/observations.csv", "PATIENT,DATE,CODE,VALUE\np1,2010-01-01,8480-6,120\np1,2011-01-01,8480-6,140\np1,2011-01-02,8480-6,none\n")
    for n, d in (("procedures", "DATE"), ("immunizations", "DATE"), ("careplans", "START")):
        put(r, f"Synthea Synthetic/{n}.csv", f"PATIENT,{d},DESCRIPTION\np1,2010-05-05,{n}\n")
    return str(r)


def rows(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_tabular(spark, base):
    h = rows(D.heart(spark, base), "patient_id")
    assert [h[i]["target"] for i in (1, 2, 3)] == [0, 1, 0] and h[1]["ca"] == 2.0
    s = rows(D.heart_sites(spark, base), "patient_id")
    assert len(s) == 4 and {(r["site"], r["site_numeric"]) for r in s.values()} in ({("cleveland", 0), ("va", 1)}, {("cleveland", 1), ("va", 0)})
    b = rows(D.breast(spark, base), "patient_id")
    assert (b[842302]["target"], b[7]["target"], len(b[7])) == (1, 0, 32)
    p = rows(D.hepatitis(spark, base), "patient_id")
    assert {(r["target"], r["age"]) for r in p.values()} == {(1, 1.0), (0, 1.0)}
    d = D.dermatology(spark, base).orderBy("patient_id").collect()
    assert [(r["target"], r["feature_3"]) for r in d] == [(1, 55.0), (0, 55.0)]
    t = D.thyroid(spark, base).orderBy("patient_id").collect()
    assert [(r["target"], r["t3_resin_uptake"], r["total_serum_triiodothyronine"]) for r in t] == [(0, 107.0, 2.2), (2, 107.0, 2.2)]


def test_visits_and_surveys(spark, base):
    a = rows(D.appointments(spark, base), "patient_id")
    assert (a[11]["days_advance"], a[11]["target"], a[12]["days_advance"], a[12]["target"]) == (-1, 0, 4, 1)
    c = D.covid(spark, base).orderBy("patient_id").collect()
    assert [(r["fever"], r["dry_cough"], r["contact"], r["target"]) for r in c] == [(1, 1, 0, 1), (0, 1, 1, 0)]
    d = rows(D.diabetes(spark, base), "patient_id")
    assert (d[5]["age_numeric"], d[5]["target"], d[5]["admission_type_id_desc"], d[5]["discharge_disposition_id_desc"]) == (55, 0, "Emergency", "Unknown")
    assert (d[6]["race_numeric"], d[6]["admission_type_id_desc"], d[6]["target"]) == (0, "Unknown", 1)


def test_texts(spark, base):
    q = rows(D.question_pairs(spark, base), "pair_group_id")
    assert q[1]["concept_alignment"] == 1 and q[1]["shared_concept_domain"] == "Cardiology" and q[-1]["secondary_word_count"] == 2
    assert q[-1]["token_jaccard"] == pytest.approx(1 / 3) and q[-1]["concept_pair_summary"] == "General ↔ General"
    r = rows(D.drug_reviews(spark, base), "review_id")
    assert set(r) == {"1", "3"}
    assert (r["1"]["drug_rxnorm_code"], r["1"]["effectiveness_minus_side_effects"], r["1"]["total_review_word_count"]) == ("RXNORM:860975", 3, 3)
    assert (r["3"]["condition"], r["3"]["net_rating_vs_side_effects"], r["3"]["dataset_split"]) == ("Unknown", -2, "test")
    i = rows(D.lesion_images(spark, base), "lesion_label")
    assert (i["melanoma"]["target"], i["melanoma"]["lesion_icd10_code"], i["nevus"]["lesion_risk_category"]) == (1, "C43.9", "benign")


def test_longitudinal(spark, base):
    p = rows(D.longitudinal(spark, base), "patient_id")
    a, b = p["p1"], p["p2"]
    assert (a["n_encounters"], a["median_encounter_duration_days"], a["emergency_encounter_count"]) == (2, 0.75, 1)
    assert (a["n_chronic_conditions"], a["n_unique_condition_codes"], a["dominant_condition_domain"]) == (2, 2, "Cardiology")
    assert (a["systolic_bp_mean"], a["systolic_bp_last"], a["numeric_observation_count"]) == (130.0, 140.0, 2)
    assert (a["temporal_event_count"], a["encounter_time_span_days"], a["target"], a["age_at_last_encounter_years"]) == (9, 731, 1, 62.0)
    assert a["temporal_event_summary"].startswith('[{"date":"2010-01-01T00:00:00","type":"condition","label":"Heart failure"}')
    assert (b["n_encounters"], b["target"], b["has_death_date"], b["gender_code"], b["temporal_event_summary"]) == (None, 0, 1, 0, "[]")


def test_build_all(spark, base, tmp_path):
    got = {r["dataset"]: r["n_rows"] for r in D.build_all(spark, base, str(tmp_path / "out")).collect()}
    assert len(got) == 13 and got["heart_disease_multicenter"] == 4
