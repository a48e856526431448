import pytest

from epochwise.config import Band, Settings


def test_mapping_and_bins():
    s = Settings.from_mapping(
        {
            "freqBands": {"Delta": [0.5, 4], "Beta": [12, 30], "custom1": [9, 11]},
            "windowLength": 3,
            "stepSize": 0.3,
            "method": "Welch",
        },
        rate=500.0,
    )
    assert (s.fmin, s.fmax, s.epoch_samples, s.stride) == (0.5, 30.0, 1501, 150.0)
    freqs = [f for _, f in s.bins()]
    assert len(freqs) == 15 and freqs[0] == 500 / 256 and freqs[-1] <= 30


def test_upper_limit_is_included():
    s = Settings(rate=64.0, window=1.0, step=0.5, nfft=32)
    assert s.bins()[-1] == (15, 30.0)


def test_spectrum_between_two_bands():
    bands = (*Settings(rate=100.0, nfft=64).bands, Band("Gamma", 30, 40))
    s = Settings(rate=100.0, nfft=64, bands=bands)
    assert (s.fmin, s.fmax) == (0.5, 40.0)
    assert s.between("Theta", "Beta").bins()[-1][1] <= 30.0
    assert s.between("Theta", "Beta").fmin == 4.0


@pytest.mark.parametrize(
    "values",
    [
        {"method": "fourier"},
        {"window": 0.0},
        {"nfft": 10_000},
        {"bands": ()},
        {"bands": (Band("a", 1, 2), Band("a", 2, 3))},
        {"step": 0.001},
    ],
)
def test_bad_settings_are_refused(values):
    with pytest.raises(ValueError):
        Settings(rate=100.0, **values)


def test_bad_band_is_refused():
    with pytest.raises(ValueError):
        Band("x", 4, 4)
