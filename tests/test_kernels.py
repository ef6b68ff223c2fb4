"""Kernels on seeded arrays: known values recovered, and orders that must hold."""

import numpy as np
import pytest

from loomtick.operators import kernels as K

RNG = np.random.default_rng(7)
YY, XX = np.mgrid[:96, :128]
SCENE = 0.5 + 0.2 * np.sin(XX / 9.0) * np.cos(YY / 7.0) + 0.05 * K._blurred(RNG.standard_normal((96, 128)))


@pytest.mark.parametrize("sigma", [0.01, 0.03])
def test_noise_is_recovered_and_texture_silent(sigma):
    noisy = [SCENE + sigma * RNG.standard_normal(SCENE.shape) for _ in range(2)]
    assert abs(K.noise_level(*noisy)["median"] / sigma - 1) < 0.15
    assert K.noise_level(SCENE, SCENE)["top"] == 0
    moved = noisy[1].copy()
    moved[:32, :32] = RNG.random((32, 32))
    assert K.noise_level(noisy[0], moved)["top"] < 4 * sigma


def test_shift():
    dy, dx, peak = K.shift(SCENE, np.roll(SCENE, (3, -5), (0, 1)))
    assert abs(dy - 3) < 0.3 and abs(dx + 5) < 0.3 and peak > 0.5


def test_blockiness_finds_phase():
    tiles = RNG.random((12, 16)).repeat(8, 0).repeat(8, 1) * 0.2 + SCENE
    found = K.blockiness(np.roll(tiles, (2, 3), (0, 1)))
    assert (found["phase_x"], found["phase_y"]) == (3, 2) and found["blockiness"] > 0.5 > K.blockiness(SCENE)["blockiness"]


def test_dct_and_comb():
    c = K.dct8(SCENE)
    assert np.isclose((c**2).sum(), ((SCENE * 255 - 128) ** 2).sum())
    v = RNG.laplace(0, 40, 5000)
    step, strength = K.comb_step(np.round(v / 12) * 12 + RNG.normal(0, 0.4, 5000))
    assert abs(step - 12) <= 0.25 and strength > 0.6
    assert K.comb_step(v)[0] == 0


def test_geometry():
    assert np.allclose(K.resample(np.full((4, 30), 0.3), 17), 0.3)
    assert abs(K.resample(SCENE, 64).mean() - SCENE.mean()) < 0.01
    assert K.crop(SCENE, 1, 2, 11, 13).shape == (10, 12)
    with pytest.raises(ValueError):
        K.crop(SCENE, 90, 0, 20, 20)
    e = K.extend_edges(SCENE, 2, 1, 3, 0)
    assert (e[0, 0] == SCENE[2, 3]) and (e[-1, 5] == SCENE[-2, 5]) and (e[2:-1, 3:] == SCENE[2:-1, 3:]).all()
    flow = np.zeros((*SCENE.shape, 2))
    assert np.allclose(K.warp(SCENE, flow), SCENE)
    flow[..., 0] = 1
    assert np.allclose(K.warp(SCENE, flow)[:, :-1], SCENE[:, 1:])
    rgb = RNG.random((4, 5, 3))
    wet = RNG.random((4, 5, 3))
    assert np.allclose(K.blend(rgb, wet, 1, 1), wet) and np.allclose(K.blend(rgb, wet, 0, 0), rgb)


def test_blur_moves_statistics():
    noisy = SCENE + 0.1 * RNG.standard_normal(SCENE.shape)
    sharp, soft = K.statistics(noisy), K.statistics(K._blurred(noisy))
    assert soft["product_h"] > sharp["product_h"] and 1.2 < sharp["shape"] < 4
    assert K.contrast_risk(SCENE, noisy)["weighted"] > K.contrast_risk(SCENE, SCENE)["weighted"] == 0


def test_frames_in_spark(spark):
    frames = [SCENE, SCENE + 0.02 * RNG.standard_normal(SCENE.shape)]
    rows = [(1, i, 96, 128, f.ravel().tolist()) for i, f in enumerate(frames)]
    df = spark.createDataFrame(rows, "stream_id long, pos long, height int, width int, pixels array<double>")
    one = K.per_frame(df, K.blockiness, ["blockiness", "phase_x", "phase_y"]).orderBy("pos").collect()
    assert [r.blockiness for r in one] == [K.blockiness(f)["blockiness"] for f in frames]
    pair = K.per_pair(df, K.noise_level, ["floor", "median", "top"]).collect()
    assert len(pair) == 1 and pair[0].median == K.noise_level(*frames)["median"]
