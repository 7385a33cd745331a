"""Queries over the test tables, a module for each part of the inventory."""

from kinelake.plans.queries import aggregate, interval, join, project, robot, sample, scan, scalar, stream, window  # noqa: F401
