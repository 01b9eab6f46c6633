from tarnwood.functions.suppress import directives, matchers, suppressed


def test_directives(spark):
    files = spark.createDataFrame([("a", "x\n# lint:ignore-next-line a.b, c.*\ny  // lint:ignore d\nz"), ("b", "nothing")], "path string, text string")
    covers = matchers(directives(files, "path", "text"), "path")
    assert sorted(map(tuple, covers.collect())) == [("a", 3, "a.b"), ("a", 3, "c.*"), ("a", 3, "d")]
    f = spark.createDataFrame([("a", 3, "a.b"), ("a", 3, "a.bc"), ("a", 3, "c.x"), ("a", 2, "d"), ("b", 3, "d")], "path string, line int, id string")
    assert sorted((r.line, r.id) for r in suppressed(f, covers, "path").collect()) == [(3, "a.b"), (3, "c.x")]
