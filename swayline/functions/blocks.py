"""Entity elimination for the whole-data probit: small blocks, one Arrow batch of entities at a time.

Per (entity, group) pair Spark has summed the score and information of a + b * x. Entities own
two parameters each, groups one; eliminating the entities leaves a groups x groups system.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# n, a, b, score (1, x), observed information (1, x, x * x), expected information (1, x, x * x)
WIDTH = 11
OBSERVED, EXPECTED = 5, 8


def _unpack(batch):
    places = batch.column("places")
    sizes = np.diff(places.offsets.to_numpy())
    group = places.flatten().to_numpy(zero_copy_only=False)
    sums = batch.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
    owner = np.repeat(np.arange(batch.num_rows), sizes)
    starts = np.searchsorted(owner, np.arange(batch.num_rows))
    return group, sums, owner, np.add.reduceat(sums, starts, axis=0)


class Blocks:
    """Inverse 2x2 blocks and their coupling with the groups, for one batch."""

    def __init__(self, batch, groups, kind=OBSERVED):
        self.group, self.sums, self.owner, total = _unpack(batch)
        h00, h01, h11 = total[:, kind], total[:, kind + 1], total[:, kind + 2]
        det = np.maximum(h00 * h11 - h01**2, 1e-300)
        self.inverse = np.stack([np.stack([h11, -h01], 1), np.stack([-h01, h00], 1)], 1) / det[:, None, None]
        self.score = total[:, 3:5]
        self.coupling = np.zeros((batch.num_rows, 2, groups))
        self.coupling[self.owner, 0, self.group] = self.sums[:, kind]
        self.coupling[self.owner, 1, self.group] = self.sums[:, kind + 1]
        self.pull = np.einsum("eij,ejg->eig", self.inverse, self.coupling)
        self.own_step = np.einsum("eij,ej->ei", self.inverse, self.score)
        self.direct = np.bincount(self.group, self.sums[:, kind], groups)

    def system(self):
        """Group system with the entities eliminated."""
        return np.diag(self.direct) - np.einsum("eig,eih->gh", self.coupling, self.pull)


def eliminator(groups):
    """mapInArrow function: per task the reduced system, its right side, and the Newton decrement."""

    def run(batches):
        system, right = np.zeros((groups, groups)), np.zeros(groups)
        expected = np.zeros((groups, groups))
        together, decrement = np.zeros((groups, groups)), 0.0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            blocks = Blocks(batch, groups)
            system += blocks.system()
            expected += Blocks(batch, groups, EXPECTED).system()
            right += np.bincount(blocks.group, blocks.sums[:, 3], groups)
            right -= np.einsum("eig,ei->g", blocks.pull, blocks.score)
            present = (blocks.coupling[:, 0, :] > 0).astype(float)
            together += present.T @ present
            decrement += float(np.sum(blocks.own_step * blocks.score))
        yield pa.RecordBatch.from_pydict({
            "system": pa.array([system.ravel().tolist()]), "right": pa.array([right.tolist()]),
            "expected": pa.array([expected.ravel().tolist()]),
            "together": pa.array([together.ravel().tolist()]), "decrement": pa.array([decrement]),
        })

    return run


def stepper(group_step, largest):
    """mapInArrow function: the pairs after the Newton step."""

    def run(batches):
        groups = len(group_step)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            blocks = Blocks(batch, groups)
            step = np.clip(blocks.own_step - blocks.pull @ group_step, -largest, largest)
            take = pa.array(blocks.owner)
            yield pa.RecordBatch.from_pydict({
                "entity": batch.column("entity").take(take), "place": pa.array(blocks.group, pa.int32()),
                "a": pa.array(blocks.sums[:, 1] + step[blocks.owner, 0] + group_step[blocks.group]),
                "b": pa.array(blocks.sums[:, 2] + step[blocks.owner, 1]), "n": pa.array(blocks.sums[:, 0]),
            })

    return run


def reporter(inverse_system, reference_pull, group_level):
    """mapInArrow function: per entity its level, slope and what the contrast variances need."""

    def run(batches):
        groups = len(group_level)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            blocks = Blocks(batch, groups, EXPECTED)
            first = np.searchsorted(blocks.owner, np.arange(batch.num_rows))
            pull = blocks.pull[:, 1, :]
            through = pull @ inverse_system
            yield pa.RecordBatch.from_pydict({
                "entity": batch.column("entity"),
                "level": pa.array(blocks.sums[first, 1] - group_level[blocks.group[first]]),
                "slope": pa.array(blocks.sums[first, 2]),
                "var_slope": pa.array(blocks.inverse[:, 1, 1] + np.sum(through * pull, axis=1)),
                "cov_reference": pa.array(through @ reference_pull),
                "place": pa.array(blocks.group[first], pa.int32()),
                "own": pa.array(blocks.inverse.reshape(-1, 4)[:, [0, 1, 3]].tolist(), pa.list_(pa.float64())),
                "pull_level": pa.array(blocks.pull[:, 0, :].tolist(), pa.list_(pa.float64())),
                "pull_slope": pa.array(pull.tolist(), pa.list_(pa.float64())),
            })

    return run


def pull_of(batch_row, groups):
    """Slope row of the pull of one packed entity (used for the reference)."""
    batch = pa.RecordBatch.from_pydict({
        "entity": pa.array([batch_row["entity"]]), "places": pa.array([batch_row["places"]], pa.list_(pa.int32())),
        "sums": pa.array([batch_row["sums"]], pa.list_(pa.float64())),
    })
    return Blocks(batch, groups, EXPECTED).pull[0, 1, :]


cloudpickle.register_pickle_by_value(sys.modules[__name__])
