"""Gaussian-process models: fitted on the driver with numpy, predicted by the executors."""
