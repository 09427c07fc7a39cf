from unittest.mock import MagicMock

import pytest

from peakloom.llm import common


@pytest.mark.parametrize(("master", "local"), [("local", True), ("local[8]", True), ("local[*]", True), ("local-cluster[3,2,3000]", False), ("yarn", False), ("spark://h:7077", False)])
def test_a_cluster_needs_a_shared_folder(master, local):
    spark = MagicMock()
    spark.conf.get.side_effect = lambda key, default: default
    spark.sparkContext.master = master
    spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty.return_value = True
    spark.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False
    if local:
        assert common.shared_dir(spark)
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(spark)
