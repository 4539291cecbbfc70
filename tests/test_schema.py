import pytest

from drawfield import schema


def test_published_columns():
    columns = schema.published_columns()
    assert len(columns) == len(set(columns)) == 45
    assert columns[:3] == ["month_id", "admin1_code", "admin1_name"]
    assert columns[6:19] == ["sb_map", "sb_hdi50_lower", "sb_hdi50_upper", "sb_hdi90_lower", "sb_hdi90_upper",
                             "sb_hdi95_lower", "sb_hdi95_upper", "sb_severe_scenario", "sb_bimodality_flag",
                             "sb_p_gt25", "sb_p_gt100", "sb_p_gt1000", "sb_actual"]
    assert len(schema.series_columns("os", actual=False)) == 12


def test_unknown_names_are_refused():
    for call in (lambda: schema.hdi_column("sb", 0.8, "lower"), lambda: schema.hdi_column("sb", 0.9, "middle"),
                 lambda: schema.exceedance_column("sb", 7), lambda: schema.level_column("gaul3")):
        with pytest.raises(ValueError):
            call()
    assert schema.hdi_column("sb", 0.9, "lower") == "sb_hdi90_lower"
    assert schema.exceedance_column("ns", 1000) == "ns_p_gt1000"


@pytest.mark.parametrize("name, series", [("pred_lr_ged_sb", "sb"), ("pred_ln_ns_best", "ns"), ("LR_GED_OS", "os")])
def test_series(name, series):
    assert schema.series_of(name) == series


@pytest.mark.parametrize("name", ["pred_x", "sb_os", "sbx"])
def test_no_single_series(name):
    with pytest.raises(ValueError):
        schema.series_of(name)


def test_renames():
    assert schema.consumer_name("pred_lr_ged_sb_hdi90_lower") == "sb_hdi90_lower"
    assert schema.consumer_name("admin1_gaul1_name") == "admin1_gaul1_name"
    assert schema.consumer_name("pred_ns_p_gt1000") == "ns_p_gt1000"
    with pytest.raises(ValueError):
        schema.consumer_names(["pred_sb_best_map", "pred_sb_prob_map"])
