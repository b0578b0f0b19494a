"""Leading eigenpairs of a symmetric matrix that is known only by its products with blocks of vectors.

A block Jacobi-Davidson method. The subspace is searched by Rayleigh-Ritz; for every wanted pair that has
not converged the correction equation, projected beside all locked and current vectors, is solved
approximately by a few steps of MINRES, all pairs in step, so that one product serves them all. The
corrections extend the subspace, converged pairs are locked in falling order, and the subspace is
restarted with its best vectors when it grows too large. Everything held here is a few dozen vectors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

# Steps of MINRES for a correction, and rounds after which no convergence is an error.
INNER, ROUNDS = 6, 200
# Residuals must fall to the first, in parts of the largest eigenvalue; once they stop falling, the second will do.
RESIDUAL, STALLED, PATIENCE = 64 * np.finfo(float).eps, 1e-12, 4


def orthonormal(block: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """A basis of what ``block`` spans beside an orthonormal ``beside``; directions lost to rounding are left out."""
    for _ in range(2):
        block = block - beside @ (beside.T @ block)
        sizes = np.linalg.norm(block, axis=0)
        block = block[:, sizes > 1e-300] / sizes[sizes > 1e-300]
    left, sizes, _ = np.linalg.svd(block, full_matrices=False)
    basis = left[:, sizes > 1e-10]
    # The last bits that point into ``beside``.
    basis = basis - beside @ (beside.T @ basis)
    return np.linalg.qr(basis)[0]


def corrections(product: Callable, values: np.ndarray, residuals: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """For each pair, the vector t beside ``beside`` that nearly solves (A - value) t = -residual there.

    Minimal residual over the Lanczos basis that begins with the residual: a tridiagonal least-squares
    problem for each column.
    """
    project = lambda block: block - beside @ (beside.T @ block)
    right = project(-residuals)
    sizes = np.linalg.norm(right, axis=0)
    now, before = right / np.maximum(sizes, 1e-300), np.zeros_like(right)
    bases, alphas, betas = [now], [], []
    beta = np.zeros(len(values))
    for _ in range(INNER):
        image = project(product(now) - now * values)
        alpha = (now * image).sum(axis=0)
        image = image - now * alpha - before * beta
        beta = np.linalg.norm(image, axis=0)
        alphas.append(alpha)
        betas.append(beta)
        before, now = now, image / np.maximum(beta, 1e-300)
        bases.append(now)
    out = np.zeros_like(right)
    for i in range(len(values)):
        # Beyond a vanishing beta the basis ends.
        scale = max(abs(a[i]) for a in alphas) + max(b[i] for b in betas)
        steps = next((j + 1 for j in range(INNER) if betas[j][i] <= 1e-14 * scale), INNER)
        band = np.zeros((steps + 1, steps))
        for j in range(steps):
            band[j, j], band[j + 1, j] = alphas[j][i], betas[j][i]
            if j + 1 < steps:
                band[j, j + 1] = betas[j][i]
        wanted = np.zeros(steps + 1)
        wanted[0] = sizes[i]
        weights = np.linalg.lstsq(band, wanted, rcond=None)[0]
        out[:, i] = sum(w * bases[j][:, i] for j, w in enumerate(weights))
    return out


def leading(product: Callable[[np.ndarray], np.ndarray], dimension: int, wanted: int, largest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues in falling order and their unit vectors as columns.

    ``product(block)`` is the matrix times a block of columns; the matrix is symmetric and has no negative
    eigenvalue. ``largest`` bounds the subspace.
    """
    wanted = min(wanted, dimension)
    largest = min(dimension, largest or 4 * wanted + 8)
    locked, values = np.zeros((dimension, 0)), np.zeros(0)
    start = np.random.default_rng(1).standard_normal((dimension, min(dimension, wanted + 4)))
    space = np.linalg.qr(start)[0]
    images = product(space)
    best, waited, accepted = np.inf, 0, RESIDUAL
    for _ in range(ROUNDS):
        projected = space.T @ images
        ritz, turn = np.linalg.eigh((projected + projected.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        space, images = space @ turn, images @ turn
        missing = wanted - len(values)
        residuals = images[:, :missing] - space[:, :missing] * ritz[:missing]
        residuals = residuals - locked @ (locked.T @ residuals)
        scale = max(values[0] if len(values) else ritz[0], 0.0)
        norms = np.linalg.norm(residuals, axis=0)
        if scale == 0:
            return np.zeros(wanted), space[:, :wanted]
        # Only pairs below which all larger ones have converged are locked, so the order is kept.
        done = int(np.argmin(np.append(norms <= accepted * scale, False)))
        if done:
            locked, values = np.hstack([locked, space[:, :done]]), np.append(values, ritz[:done])
            space, images, residuals, ritz, norms = space[:, done:], images[:, done:], residuals[:, done:], ritz[done:], norms[done:]
            best, waited = np.inf, 0
        if len(values) == wanted:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        worst = norms.max() / scale
        best, waited = (worst, 0) if worst < best / 2 else (best, waited + 1)
        if waited >= PATIENCE and worst <= STALLED:
            accepted = STALLED
        missing = wanted - len(values)
        if space.shape[1] + missing > largest - len(values):
            keep = min(space.shape[1], missing + max(4, missing // 2))
            space, images = space[:, :keep], images[:, :keep]
        open_pairs = norms > accepted * scale
        beside = np.hstack([locked, space[:, :missing]])
        steps = corrections(product, ritz[:missing][open_pairs], residuals[:, open_pairs], beside)
        fresh = orthonormal(steps, np.hstack([locked, space]))
        if fresh.shape[1]:
            space, images = np.hstack([space, fresh]), np.hstack([images, product(fresh)])
        else:
            # The subspace is the whole space: only rounding is left.
            accepted = STALLED
    raise ArithmeticError(f"no convergence: residual {best:.1e} of the largest eigenvalue")
