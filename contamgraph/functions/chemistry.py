"""Chemistry backend: optional, loaded where it is used.

The functions need an RDKit installation on the executors; without one, using them
raises ``BackendMissing`` with a plain message.  Everything else in the engine works
on keys that were computed before, or on the text backend of the adapters.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class BackendMissing(RuntimeError):
    """The chemistry library is not installed."""


def backend():
    try:
        from rdkit import Chem
    except ImportError as e:
        raise BackendMissing("chemistry functions need RDKit on driver and executors") from e
    return Chem


FEATURES = "struct<smiles_canonical:string,inchikey:string,scaffold_smiles:string,parent_inchikey:string,n_heavy:int,fp:array<bigint>,parse_ok:boolean>"


def _featurize(smiles: pd.Series) -> pd.DataFrame:
    Chem = backend()
    from rdkit.Chem import rdFingerprintGenerator
    from rdkit.Chem.MolStandardize import rdMolStandardize
    from rdkit.Chem.Scaffolds import MurckoScaffold

    generator = rdFingerprintGenerator.GetMorganGenerator(radius=2, fpSize=2048)
    rows = []
    for s in smiles:
        mol = Chem.MolFromSmiles(s.strip()) if s and s.strip() else None
        if mol is None:
            rows.append((None, None, None, None, -1, None, False))
            continue
        core = MurckoScaffold.GetScaffoldForMol(mol)
        parent = rdMolStandardize.Uncharger().uncharge(rdMolStandardize.FragmentParent(mol))
        Chem.RemoveStereochemistry(parent)
        words = memoryview(generator.GetFingerprintAsNumPy(mol).astype("uint8")).tobytes()
        lanes = [int("".join(str(b) for b in words[i : i + 64][::-1]), 2) for i in range(0, 2048, 64)]
        rows.append((
            Chem.MolToSmiles(mol), Chem.MolToInchiKey(mol), Chem.MolToSmiles(core) if core.GetNumAtoms() else "",
            Chem.MolToInchiKey(parent), mol.GetNumHeavyAtoms(), [x - (1 << 64) if x >> 63 else x for x in lanes], True,
        ))
    return pd.DataFrame(rows, columns=["smiles_canonical", "inchikey", "scaffold_smiles", "parent_inchikey", "n_heavy", "fp", "parse_ok"])


def featurize(smiles: Column) -> Column:
    """All features of a molecule from one parse, as a struct."""
    backend()
    return F.pandas_udf(_featurize, FEATURES)(smiles)


def _sizes(smiles: pd.Series) -> pd.Series:
    Chem = backend()

    def size(s):
        if not s:
            return 0
        mol = Chem.MolFromSmiles(s)
        return -1 if mol is None else mol.GetNumHeavyAtoms()

    return smiles.map(size)


def heavy_atoms(smiles: Column) -> Column:
    """Heavy atoms of a molecule: 0 for empty text, -1 for one that cannot be parsed."""
    backend()
    return F.pandas_udf(_sizes, "long")(smiles)


def _flat(smiles: pd.Series) -> pd.Series:
    Chem = backend()

    def flat(s):
        mol = Chem.MolFromSmiles(s) if s is not None else None
        if mol is None:
            return s if s is None else s.translate(str.maketrans("", "", "/\\@"))
        Chem.RemoveStereochemistry(mol)
        return Chem.MolToSmiles(mol)

    return smiles.map(flat)


def stereo_free(smiles: Column) -> Column:
    """Canonical text without stereochemistry."""
    backend()
    return F.pandas_udf(_flat, "string")(smiles)
