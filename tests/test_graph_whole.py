def test_whole_graph_has_every_customer(spark, sf_dir):
    from lodeline.plans import graph

    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    assert graph.g8_degrees(spark, sf_dir).where("node_id rlike '^c[0-9]+$'").count() == customers
