from types import SimpleNamespace

import pytest
from voxelstream.llm import common


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda name: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        session = SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: None))
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(session)
