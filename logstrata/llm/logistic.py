"""A small logistic regression for calibration and for hashed linear scores."""

from __future__ import annotations

import numpy as np


class Logistic:
    def __init__(self, x, y, penalty: float = 1.0, rounds: int = 60):
        """Newton steps on few features, halved until they help; ``y`` may be probabilities."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        a = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        self.w = np.zeros(a.shape[1])
        ridge = penalty * np.eye(a.shape[1])
        ridge[0, 0] = 1e-6

        def loss(w):
            z = a @ w
            return float(np.logaddexp(0, z).sum() - y @ z + w @ ridge @ w / 2)

        now = loss(self.w)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ self.w, -30, 30)))
            hessian = a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + ridge
            step = np.linalg.solve(hessian, a.T @ (y - p) - ridge @ self.w)
            while (then := loss(self.w + step)) > now and abs(step).max() > 1e-9:
                step = step / 2
            self.w, before, now = self.w + step, now, then
            if before - now < 1e-9 * (1 + abs(now)):
                break

    def __call__(self, x):
        z = np.c_[np.ones(len(x)), (np.asarray(x, float) - self.mean) / self.scale] @ self.w
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
