"""The short names that the plans import their modules by are not given to anything else."""

import ast
import glob
import os

import pytest

PLANS = sorted(glob.glob(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "sensorloom", "plans", "*.py")))


@pytest.mark.parametrize("path", PLANS, ids=os.path.basename)
def test_module_names_are_not_reused(path):
    with open(path, encoding="utf-8") as f:
        body = ast.parse(f.read()).body
    imported = [a.asname or a.name for n in body if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names]
    given = [n.name for n in body if isinstance(n, (ast.FunctionDef, ast.ClassDef))]
    given += [t.id for n in body if isinstance(n, ast.Assign) for t in ast.walk(ast.Tuple(n.targets, ast.Load())) if isinstance(t, ast.Name)]
    assert len(imported) == len(set(imported))
    assert not set(imported) & set(given)
