import __spark_entry__ as contract
from matchlog.queries import QUERIES


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and {"game_id", "winner", "duration"} <= set(df.columns)


def test_keys():
    queries, statements = contract.queries(), contract.oracle_sql()
    assert set(statements) <= set(queries) and len(queries) > 50
    # only fitted models have no SQL
    assert set(QUERIES) - set(statements) == {
        "map_clusters", "unit_pca", "gbt_scores", "rf_depth_sweep", "feature_importance",
        "learning_curve", "cv_learning_curve", "cv_search", "fitted_map_matrix", "all_games_answered",
    }
