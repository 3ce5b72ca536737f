"""Registered queries of the corpus operators: name -> (Spark callable, SQL twin or None)."""
from .eulertour import QUERIES as eulertour
from .learnedparts import QUERIES as learnedparts
from .merkle import QUERIES as merkle
from .mixing import QUERIES as mixing
from .prefixbpe import QUERIES as prefixbpe
from .rulefit import QUERIES as rulefit
from .simhash import QUERIES as simhash
from .sitelines import QUERIES as sitelines
from .stringkernel import QUERIES as stringkernel
from .tokenids import QUERIES as tokenids
from .transducer import QUERIES as transducer
from .urllists import QUERIES as urllists
from .wumanber import QUERIES as wumanber

CATALOG = {**learnedparts, **urllists, **wumanber, **stringkernel, **sitelines, **transducer, **simhash, **mixing,
           **rulefit, **tokenids, **prefixbpe, **eulertour, **merkle}
