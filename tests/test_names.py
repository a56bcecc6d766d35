"""Column-name catalogue: literal expectations (fixed values from the reference's own test cases),
checked on the driver-side functions and on the Spark-expression catalogue."""
import pytest

from fluxsieve.functions import names as N
from fluxsieve.functions.name_columns import name_catalog

NAMES = ["pfe_GB", "pfeETG_SI", "pfeITG_SI_div_efeETG_GB", "pfeITG_SI_div_pfeTEM_GB", "efe_GB",
         "efe_GB_plus_efiITG_GB", "efeTEM_GB_plus_efiTEM_GB", "efeTEM_GB_plus_efi_GB", "efeITG_GB_plus_efiITG_GB",
         "efeITG_GB_plus_efi_GB", "efeETG_GB_plus_efiETG_GB", "efeETG_GB_plus_efi_GB", "chiee_GB", "gam_GB"]
T, F_ = True, False
EXPECT = {  # name: (transport, partial_particle, pure_heat, tem, itg, etg, ion, electron, multi, pure_flux, special, mode)
    "pfe_GB": (T, T, F_, F_, F_, F_, F_, F_, T, T, [], "unknown"),
    "pfeETG_SI": (T, T, F_, F_, F_, T, F_, T, F_, T, ["Ate"], "ETG"),
    "pfeITG_SI_div_efeETG_GB": (T, T, F_, F_, F_, F_, F_, F_, T, F_, [], "unknown"),
    "pfeITG_SI_div_pfeTEM_GB": (T, T, F_, F_, F_, F_, T, F_, F_, F_, [], "unknown"),
    "efe_GB": (T, F_, T, F_, F_, F_, F_, F_, T, T, [], "unknown"),
    "efe_GB_plus_efiITG_GB": (T, F_, T, F_, F_, F_, F_, F_, T, F_, [], "unknown"),
    "efeTEM_GB_plus_efiTEM_GB": (T, F_, T, T, F_, F_, T, F_, F_, F_, ["Ate"], "TEM"),
    "efeTEM_GB_plus_efi_GB": (T, F_, T, F_, F_, F_, F_, F_, T, F_, [], "unknown"),
    "efeITG_GB_plus_efiITG_GB": (T, F_, T, F_, T, F_, T, F_, F_, F_, ["Ati"], "ITG"),
    "efeITG_GB_plus_efi_GB": (T, F_, T, F_, F_, F_, F_, F_, T, F_, [], "unknown"),
    "efeETG_GB_plus_efiETG_GB": (T, F_, T, F_, F_, T, F_, T, F_, F_, ["Ate"], "ETG"),
    "efeETG_GB_plus_efi_GB": (T, F_, T, F_, F_, F_, F_, F_, T, F_, [], "unknown"),
    "chiee_GB": (T, F_, T, F_, F_, F_, F_, F_, T, F_, [], "unknown"),
    "gam_GB": (F_, F_, F_, F_, F_, F_, F_, F_, F_, F_, [], "unknown"),
}


def py_row(n):
    return (N.is_transport(n), N.is_partial_particle(n), N.is_pure_heat(n), N.is_mode_scale(n, "TEM"),
            N.is_mode_scale(n, "ITG"), N.is_mode_scale(n, "ETG"), N.is_ion_scale(n), N.is_electron_scale(n),
            N.is_multi_scale(n), N.is_pure_flux(n), N.determine_special_input(n), N.determine_mode_scale(n))


@pytest.mark.parametrize("name", NAMES)
def test_python_catalogue(name):
    assert py_row(name) == EXPECT[name]


def test_splitting():
    assert N.split_parts("efe_GB_div_efi_GB") == ["efe_GB", "_div_", "efi_GB"]
    assert N.split_parts("efiITG_GB_fake_chiei_GB_triple_pfe_SI") == [
        "efiITG_GB", "_fake_", "chiei_GB", "_triple_", "pfe_SI"]
    for n in ["efe_GB", "efi_SI", "pfeETG_GB", "verITG_SI", "chieTEM_SI"]:
        assert N.split_parts(n) == [n]
    assert N.split_name("chieTEM_SI") == ("chi", "e", "TEM", "SI")
    with pytest.raises(TypeError):
        N.extract_part_names("efe_GB")
    with pytest.raises(TypeError):
        N.extract_operations("efe_GB")
    with pytest.raises(ValueError):
        N.split_parts("efe_GB_rot0")
    assert N.extract_operations(N.split_parts("efiITG_GB_fake_chiei_GB_triple_pfe_SI")) == ["_fake_", "_triple_"]


def test_leading():
    assert N.is_leading("efi_GB") and N.is_leading("efeITG_GB_div_efiITG_GB")
    assert not N.is_leading("efiITG_GB_div_efeITG_GB") and not N.is_leading("pfiITG_GB")
    assert N.is_leading("pfi_GB")  # total fluxes stay leading


def test_spark_catalogue_matches(spark):
    extra = ["efiITG_GB_fake_chiei_GB_triple_pfe_SI", "efe_GB_rot0", "gam_leq_GB", "efeITG_GB_div_efiITG_GB",
             "pfiITG_GB", "pfi_GB", "vriTEM_GB", "dfeITG_GB_div_efiITG_GB"]
    df = spark.createDataFrame([(n,) for n in NAMES + extra], "name string")
    rows = {r["name"]: r for r in name_catalog(df).collect()}
    for n in NAMES + extra:
        r = rows[n]
        for k, f in N.PREDICATES.items():
            assert r[k] == f(n), (n, k)
        assert r["mode_scale"] == N.determine_mode_scale(n)
        assert list(r["driving_gradients"]) == N.determine_driving_gradients(n)
        p = N.parse(n)
        assert (r["parts"] is None) == (p is None)
        if p is not None:
            assert list(r["parts"]) == N.split_parts(n)
