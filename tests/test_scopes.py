from clinframe.operators import chart


def test_scopes_of_three_roles(spark):
    callers = spark.createDataFrame([(1, "admin"), (2, "doctor"), (3, "doctor"), (50, "patient"), (51, "patient"), (9, "guest"), (None, "doctor")], "caller_id long, role string")
    patients = spark.createDataFrame([(2, 50), (3, None), (50, 7)], "id long, user_id long")
    access = spark.createDataFrame([(2, 3), (2, 3), (2, 50), (9, 2)], "doctor_user_id long, patient_id long")
    documents = spark.createDataFrame([(1, 2), (2, 2), (3, 3), (4, None)], "id long, patient_id long")
    seen = chart.scopes(callers, patients, access)
    # A patient's account sees the row that is linked to it, not the row of its own number.
    assert sorted(map(tuple, seen.collect()), key=str) == [(1, "admin", None), (2, "doctor", 3), (2, "doctor", 50), (50, "patient", 2)]
    assert sorted(map(tuple, chart.scope_counts(seen, patients, documents).collect())) == [(1, "admin", 3, 4), (2, "doctor", 2, 1), (50, "patient", 1, 2)]
    assert chart.scope_counts(seen.limit(0), patients, documents).count() == 0
