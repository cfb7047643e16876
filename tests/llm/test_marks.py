"""Marks of shingle sets bound their difference from below; spent tables go, others stay."""

import numpy as np
import pytest

from meterline.llm.neardup import marked
from meterline.llm.scratch import Scratch


@pytest.mark.parametrize("size", [0, 1, 40, 3000])
def test_marks_differ_in_no_more_bits_than_sets_in_members(size):
    random = np.random.default_rng(size)
    common = random.integers(0, 2**63, size, dtype=np.uint64)
    for extra in (0, 1, 30, 700):
        more = np.unique(np.r_[common, random.integers(0, 2**63, extra, dtype=np.uint64)])
        ends = np.array([0, len(common), len(common) + len(more)])
        one, two = marked(np.r_[common, more], ends)
        differing = sum(int(x).bit_count() for x in (one ^ two).view(np.uint64))
        assert differing <= len(more) - len(common)
        assert (differing == 0) == (len(more) == len(common)) or extra > 1


def test_only_spent_tables_of_its_own_are_removed(spark, tmp_path):
    scratch, other = Scratch(spark, "own"), Scratch(spark, "other")
    spent, kept, foreign = scratch.table(spark.range(5)), scratch.table(spark.range(7)), other.table(spark.range(3))
    scratch.drop(spent, foreign, None)
    scratch.drop(spent)
    assert kept.count() == 7 and foreign.count() == 3
    with pytest.raises(Exception, match="(?i)not.*exist|not.*found"):
        spark.read.schema("id long").parquet(f"{scratch.folder}/0").count()
