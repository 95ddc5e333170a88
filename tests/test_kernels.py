import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinetrace.functions import kernels as k

T = np.arange(500) / 50


def test_butterworth_known_coefficients():
    b, a = k.butterworth(4, 5, 50)
    assert b == pytest.approx([0.00482434, 0.01929737, 0.02894606, 0.01929737, 0.00482434], abs=1e-8)
    assert a == pytest.approx([1, -2.36951301, 2.31398841, -1.05466541, 0.18737949], abs=1e-8)


@pytest.mark.parametrize("order,cutoff,high", [(2, 5, False), (3, 8, False), (4, 5, True), (4, 0.5, True)])
def test_half_power_at_the_cutoff(order, cutoff, high):
    b, a = k.butterworth(order, cutoff, 50, high)
    z = np.exp(2j * np.pi * cutoff / 50)
    assert abs(np.polyval(b, z) / np.polyval(a, z)) == pytest.approx(0.5**0.5, abs=1e-6)
    assert np.polyval(b, 1) / np.polyval(a, 1) == pytest.approx(0 if high else 1, abs=1e-6)


def test_zero_phase_keeps_the_pass_band():
    slow, fast = np.sin(2 * np.pi * 2 * T), np.sin(2 * np.pi * 20 * T)
    b, a = k.butterworth(4, 8, 50)
    assert np.abs(k.zero_phase(b, a, slow + fast) - slow)[50:-50].max() < 0.01
    assert np.array_equal(k.zero_phase(b, a, slow[:15]), slow[:15])
    b, a = k.bandpass(4, 1, 4, 50)
    assert np.abs(k.zero_phase(b, a, slow + fast) - slow)[100:-100].max() < 0.02


def test_constant_passes_without_a_transient():
    b, a = k.butterworth(3, 8, 50)
    assert np.allclose(k.zero_phase(b, a, np.full(100, 3.0)), 3.0)


def test_peaks():
    x = np.array([0, 1, 0, 3, 3, 3, 0, 2, 0, 5.0])
    assert k.find_peaks(x).tolist() == [1, 4, 7]
    assert k.find_peaks(x, distance=4).tolist() == [4]
    assert k.find_peaks(x, prominence=1.5).tolist() == [4, 7]
    assert k.find_peaks(np.zeros(5)).tolist() == [] and k.find_peaks(np.zeros(1)).tolist() == []
    assert len(k.peaks_for_count(np.sin(2 * np.pi * T), 10, 10)) == 10


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=3, max_size=40))
def test_peaks_against_definition(values):
    x = np.array(values, float)
    want = []
    for i in range(1, len(x) - 1):
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            want.append((i + j) // 2)
    assert k.local_maxima(x).tolist() == want


@pytest.mark.parametrize("variant", ["plain", "centred", "hann", "welch"])
def test_frequency(variant):
    assert k.dominant_frequency(np.sin(2 * np.pi * 3.125 * T[:256]), 50, variant) == pytest.approx(3.125, abs=0.2)


def test_band_of_the_mean_may_pass_one():
    f = k.spectral(5 + np.sin(2 * np.pi * 5 * T[:100]), 50)
    assert f["band_0_3"] > 1 and f["band_3_8"] == pytest.approx(1)


def test_correlations():
    x = np.sin(2 * np.pi * T[:100])
    assert k.cross_correlation(x, x)[1] == 0
    assert k.autocorrelation_peak(x)[1] == pytest.approx(50, abs=1)
    assert k.autocorrelation_peak(np.zeros(4)) == (0.0, 0)


@pytest.mark.parametrize("f", [k.madgwick, k.attitude])
def test_attitude(f):
    acc, gyr = np.tile([0, 0, 9.8], (200, 1)), np.zeros((200, 3))
    q = f(acc, gyr, 0.02)
    assert np.allclose(np.linalg.norm(q, axis=1), 1) and np.allclose(q[-1], [1, 0, 0, 0])
    tilted = f(np.tile([0, 9.8, 0], (2000, 1)), np.zeros((2000, 3)), 0.02)
    assert np.allclose(k._down(tilted[-1]), [0, 1, 0], atol=0.05)


def test_tilt_settles():
    assert np.degrees(k.tilt(np.tile([0, 9.8, 9.8], (500, 1)), np.zeros((500, 3)), 0.02)[-1]) == pytest.approx([45, 0], abs=0.1)


def test_shrinkage():
    rng = np.random.default_rng(0)
    mean, cov, share = k.ledoit_wolf(rng.standard_normal((30, 5)))
    assert 0 <= share <= 1 and np.all(np.linalg.eigvalsh(cov) > 0) and mean.shape == (5,)
