"""Keypoints on drawn images."""

import numpy as np
import pytest

from folioscope.operators import images, keypoints


def blob(h=64, w=64, y=30.0, x=34.0, s=4.0):
    yy, xx = np.mgrid[:h, :w]
    v = 255 * np.exp(-((yy - y) ** 2 + (xx - x) ** 2 / 1.4) / (2 * s * s))
    return np.repeat(v[..., None], 3, 2).astype(np.uint8)


def test_a_blob_is_found_where_it_is():
    found = keypoints.detect(blob())
    assert found and any(abs(k.x - 34) < 1.5 and abs(k.y - 30) < 1.5 for k in found)
    assert all(len(k.descriptor) == 128 and k.descriptor.max() <= 255 for k in found)
    assert [k.scale for k in found] == sorted((k.scale for k in found), reverse=True)
    assert keypoints.detect(blob(), mask=np.zeros((64, 64))) == []
    assert keypoints.detect(np.full((64, 64, 1), 7, np.uint8)) == [] and keypoints.detect(np.zeros((6, 6, 3), np.uint8)) == []


def test_descriptors_move_with_the_image():
    a = [k for k in keypoints.detect(blob()) if abs(k.x - 34) < 1.5]
    b = [k for k in keypoints.detect(blob(y=34.0, x=30.0)) if abs(k.x - 30) < 1.5]
    assert a and b and np.linalg.norm(a[0].descriptor - b[0].descriptor) < 0.25 * np.linalg.norm(a[0].descriptor)


def test_blur_keeps_the_mean_and_pyramid_shapes():
    x = np.random.default_rng(1).random((40, 48))
    assert keypoints.blur(x, 1.0).mean() == pytest.approx(x.mean(), abs=0.01)
    levels, differences = keypoints.pyramid(x)[0]
    assert levels.shape == (6, 80, 96) and differences.shape == (5, 80, 96)


def test_daisy():
    out = images.EXTRACTORS["daisy"](blob())
    assert len(out) == 16 and all(len(v) == 200 for v in out)
    assert images.EXTRACTORS["daisy"](np.zeros((20, 20, 3), np.uint8)) == []
