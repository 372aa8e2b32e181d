import numpy as np
from pyspark.sql import functions as F

from polyad.operators import simplicial as K


def complex_of(spark, *facets):
    return K.close(spark.createDataFrame([(list(f), 1) for f in facets], "members array<string>, count int"))


def test_full_tetrahedron(spark):
    sc = complex_of(spark, "abcd")
    assert {r["dimension"]: r["n"] for r in K.f_vector(sc).collect()} == {0: 4, 1: 6, 2: 4, 3: 1}
    assert K.euler(sc).first()[0] == 1
    assert {r["dimension"]: r["betti"] for r in K.betti(sc).collect()} == {0: 1, 1: 0, 2: 0, 3: 0}


def test_two_triangles_at_a_vertex(spark):
    q = {r["q"]: r["n_components"] for r in K.q_analysis(complex_of(spark, "abc", "cde")).collect()}
    assert q == {2: 2, 1: 2, 0: 1}


def test_cycle_persistence(spark):
    e = spark.createDataFrame([("a", "b", 0.51), ("b", "c", 0.52), ("c", "d", 0.53), ("a", "d", 0.54)], "a string, b string, weight double")
    r = [(x["dimension"], x["birth"], x["death"]) for x in K.homology(K.cliques(e, 2)).where("death = double('infinity')").collect()]
    assert sorted(r) == [(0, 0.54, np.inf), (1, 0.51, np.inf)]


def test_rips_triangle_enters_at_the_longest_side(spark):
    e = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.5), ("a", "c", 1.0)], "a string, b string, weight double")
    assert K.cliques(e, 2, ascending=True).where("dimension = 2").first()["filtration"] == 1.0


def test_distances(spark):
    d = lambda *p: spark.createDataFrame([(0, float(b), float(z)) for b, z in p] or [], "dimension int, birth double, death double")
    none = d((0, 1)).where(F.lit(False))
    assert K.wasserstein(d((0, 2)), none) == 1 and K.wasserstein(d((0, 2)), d((1, 3))) == 1
    assert np.isclose(K.wasserstein(d((0, 2)), none, internal=2), np.sqrt(2))
    assert K.bottleneck(d((0, 2)), d((0, 3))) == 1 and K.bottleneck(d((0, np.inf)), none) == np.inf
