"""Arrays in files: what is written is read, and many more files are mapped than may be open."""

import os
import resource
import sys

import numpy as np
import pytest

from quillmark.llm import kneser_ney as kn
from quillmark.llm import lm_scoring as M


@pytest.mark.parametrize("maps", [20, None])
def test_more_mapped_files_than_may_be_open(tmp_path, monkeypatch, maps):
    if maps:
        monkeypatch.setattr(kn, "MAPS", maps, raising=False)
    elif sys.version_info < (3, 13):
        pytest.skip("a map holds its file open")
    files = [kn.saved(f"file://{tmp_path}", f"a-{i}", np.arange(i, dtype=np.uint32)) for i in range(300)]
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (max(int(x) for x in os.listdir("/proc/self/fd")) + 60, hard))
    try:
        held = [kn.mapped(f) for f in files[:30]]
        for _ in range(2):
            for i, f in enumerate(files):
                assert kn.mapped(f).tolist() == list(range(i))
        assert [x.tolist() for x in held] == [list(range(i)) for i in range(30)]
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))


def test_arrays_of_any_kind_in_one_file(tmp_path):
    given = [np.arange(3, dtype=np.uint8), np.zeros(0, np.uint64), np.arange(6, dtype=np.float32).reshape(2, 3), np.zeros((0, 3), np.uint16), np.arange(8, dtype=np.int64)[::2]]
    got = kn.arrays(kn.saved(str(tmp_path), "x", *given))
    assert [(x.dtype, x.shape, x.tolist()) for x in got] == [(x.dtype, x.shape, x.tolist()) for x in given]


def test_files_of_a_model(spark):
    """Five files a shard at most: words, triples, pairs, pairs of common words, and what precedes words."""
    df = spark.createDataFrame([(i, " ".join(f"w{i * k % 97} of the" for k in range(60))) for i in range(60)], "doc_id long, text string")
    model = M.train(df, shard_bytes=2000)
    files = {*filter(None, model.words), *model.preceding.values(), *model.common_pairs.values(), *(t.file for x in (model.triples, model.pairs) for t in x.values())}
    folder = model.words[next(i for i, f in enumerate(model.words) if f)].rsplit("/", 1)[0].removeprefix("file://")
    assert model.shards > 4 and len(os.listdir(folder)) == len(files) <= 5 * model.shards
