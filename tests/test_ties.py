"""Values that meet a threshold or a node exactly count as in the SQL, to the last bit."""

import duckdb

from roadspark.queries import ORACLE_SQL, QUERIES


def test_classify_movement_where_the_turn_is_the_limit(spark, tmp_path):
    # (heading, speed) whose turn is -0.1 but for rounding: Java's and the C library's cosines differ there
    headings = [(k * 37) % 720 - 180 for k in range(720)]
    rows = []
    for h in range(-180, 540):
        for turn in range(-6, 7):
            value = round((h * 0.0175 - 0.1 + turn * 6.283185307179586) * 10, 2)
            for loop in range(10):
                if 0 <= value < 60 and abs((h * 0.0175 - 0.1) * 10 - value) < 1e-9:
                    rows.append((headings.index(h) + 720 * (loop * 9 + 1), "view", 1, value + 60 * loop))
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(40).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = {tuple(r) for r in QUERIES["classify_movement"](spark, str(tmp_path)).collect()}
    assert len(got) > 1000 and got == {tuple(r) for r in con.execute(ORACLE_SQL["classify_movement"]).fetchall()}


def test_a_foot_at_the_far_end_is_short_of_it_as_in_the_sql(spark):
    from roadspark.operators import endpoints

    nodes = spark.createDataFrame([("a", 0.0, 0.0), ("b", 56.0, 3.0)], "node_id string, x double, y double")
    ways = spark.createDataFrame([("w", {"highway": "primary", "oneway": "yes"}, ["a", "b"])], "way_id string, tags map<string,string>, nodes array<string>")
    points = spark.createDataFrame([(1, "w", 53.0, 59.0), (2, "w", 60.0, 10.0)], "point_id long, way_id string, x double, y double")  # the first one's foot is b, the second lies beyond
    ends = endpoints.virtual_endpoints(points, ways, nodes)
    od = spark.createDataFrame([(1, 1, 2), (2, 2, 1)], "od_id long, start_id long, end_id long")
    assert [(r["od_id"], round(r["cost_sec"], 9)) for r in endpoints.same_edge_direct(od, ends).collect()] == [(1, 0.0)]
