"""Bytes that are no UTF-8 among many files."""

import pytest

from unisource.sources import files


def test_invalid_bytes_are_refused_among_many_files(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"{k}.csv").write_text('a,b\n"x\ny",1\n')
    (tmp_path / "bad.csv").write_bytes(b"a,b\n\xff,2\n")
    with pytest.raises(ValueError, match="bad.csv"):
        files.read_csv(spark, str(tmp_path))
    assert files.read_csv(spark, str(tmp_path), encoding="ISO-8859-1").rows().count() == 41
