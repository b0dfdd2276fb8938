import pytest

from catchwork.operators.catchments import APPROACHES
from catchwork.plans import settings


def test_load(tmp_path):
    (tmp_path / "s.toml").write_text('version = "v1"\n[paths]\nhome = "/data/{version}"\nsites = "{home}//sites.parquet"\nfar = "s3://bucket/{version}"\n[plume]\nc_limit = "3"\ntheta = "x"\nimpact_radii = [500]\n')
    s = settings.load(str(tmp_path / "s.toml"), version="v2")
    assert s.path("sites") == "/data/v2/sites.parquet" and s.path("far") == "s3://bucket/v2" and s.values == {"version": "v2"}
    assert (s.plume.c_limit, s.plume.theta, s.plume.impact_radii) == (3.0, 1.047, (500.0,))
    assert settings.load().plume == settings.PlumeSettings() == settings.typed(settings.PlumeSettings, None)
    with pytest.raises(KeyError):
        s.path("none")
    for templates in ({"a": "{b}", "b": "{a}"}, {"a": "{none}"}):
        with pytest.raises(ValueError):
            settings.expanded(templates, {})


def test_approaches():
    assert list(APPROACHES) == ["0", "1a", "1b", "1c", "1d", "2", "3a", "3b", "3c", "3d", "4", "5"]
    assert APPROACHES["3d"].metric == "additive" and APPROACHES["3d"].only_round and APPROACHES["3d"].buffered and not APPROACHES["1a"].buffered
