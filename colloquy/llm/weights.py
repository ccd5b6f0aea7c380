"""Fitted weights. Each table names the module that fits it; none is written by hand."""

PII: dict[str, float] = {
    "address > email": 1.518,
    "address > idnum": 0.338,
    "address > name": -0.727,
    "address > phone": 3.736,
    "address bias": 3.67,
    "address postcode": 0.116,
    "address town": 2.092,
    "email > address": 1.403,
    "email > email": 1.036,
    "email > idnum": 0.338,
    "email > name": 1.288,
    "email > phone": 3.249,
    "email at": 1.832,
    "email bias": 2.169,
    "email bracketed at": 1.842,
    "email end": 1.888,
    "email spoken": 3.111,
    "idnum > address": 1.295,
    "idnum > email": -0.329,
    "idnum > idnum": -0.765,
    "idnum > name": 0.524,
    "idnum > phone": -0.478,
    "idnum against": -2.475,
    "idnum bias": -2.082,
    "idnum cue": 7.908,
    "idnum far cue": -1.153,
    "idnum form document": -0.734,
    "idnum form nif": 1.631,
    "idnum form nino": -1.931,
    "idnum form nir": 1.085,
    "idnum form ssn": -1.259,
    "idnum form tax": 0.351,
    "idnum other form": -3.668,
    "idnum used cue": -1.299,
    "name > address": 1.726,
    "name > email": 0.366,
    "name > idnum": -0.818,
    "name > name": 0.692,
    "name > phone": 2.463,
    "name all known": -1.694,
    "name bias": -0.001,
    "name capitals": -5.207,
    "name comma": 1.325,
    "name family": 2.384,
    "name first unknown": -2.21,
    "name given": 1.26,
    "name initials": 1.726,
    "name initials after": 2.027,
    "name introduced": -1.08,
    "name introduced weakly": -1.056,
    "name lower": -3.159,
    "name lower title": -2.2,
    "name monsieur": 1.3,
    "name none known": 1.672,
    "name reversed": -1.032,
    "name second unknown": -2.263,
    "name some known": 3.277,
    "name title": 5.803,
    "name unknown": -3.891,
    "name upper": 1.831,
    "name weak title": -0.972,
    "phone > address": 1.758,
    "phone > email": 2.006,
    "phone > idnum": -1.138,
    "phone > name": 0.314,
    "phone > phone": -2.955,
    "phone against": -2.453,
    "phone alone": 0.892,
    "phone bias": -1.521,
    "phone bracketed": 3.072,
    "phone cue": 5.695,
    "phone far cue": 0.871,
    "phone identity cue": -0.767,
    "phone international": 3.352,
    "phone national form": -0.239,
    "phone no form": -3.633,
    "phone short": -2.113,
    "phone short international": -2.991,
    "phone used cue": 0.5,
}

REFUSAL: dict[str, float] = {
    "aligned": 1.702,
    "bias": -0.8,
    "first person": 1.706,
    "others": -2.56,
    "pairs": 1.532,
    "refuses": 2.536,
    "roles": 0.626,
    "rule": 2.132,
    "whole": 1.051,
}

ENDING: dict[str, float] = {
    "address at the end": -2.72,
    "bias": -1.126,
    "bracket open": 0.268,
    "closed": -4.405,
    "closed fence": -4.316,
    "comma": 3.242,
    "ellipsis": 2.708,
    "few words alone": -1.963,
    "full stop": -4.245,
    "heading": -0.907,
    "item ends in a digit": -1.868,
    "item ends in a function word": 4.037,
    "item ends in a joining word": 3.886,
    "item ends in a letter": -1.202,
    "item of one word": 1.464,
    "item without words": 6.838,
    "items of one word": -1.718,
    "line ends in a digit": 0.008,
    "line ends in a function word": 1.074,
    "line ends in a joining word": 1.986,
    "line ends in a letter": 1.272,
    "line without words": 4.185,
    "lines before are open": -1.658,
    "lines before end in stops": 1.853,
    "long line": 1.04,
    "number behind a full stop": -2.691,
    "open fence": 3.003,
    "opened": 3.91,
    "other sign": -1.121,
    "quote open": -0.431,
    "sentences before on the line": 0.159,
}

PIECE: dict[str, float] = {
    "ended": -2.152,
    "ended begins low": 1.593,
    "ended capitals": -0.32,
    "ended few words": -0.808,
    "ended function words": -0.929,
    "ended market": 0.045,
    "ended no function word": 1.095,
    "ended repeats": 0.061,
    "ended returns": 4.754,
    "ended same words": 0.076,
    "ended sells": 1.363,
    "ended separated": -0.021,
    "ended separators": -0.012,
    "ended short repeats": 5.29,
    "ended words": -1.059,
    "entry": -1.971,
    "goods": 7.213,
    "linked": 0.146,
    "linked entry": 5.828,
    "mostly linked": 4.139,
    "mostly tagged": 3.467,
    "open": -1.47,
    "open all capitals": -0.303,
    "open all capitals return": 3.169,
    "open barred": 4.165,
    "open begins low": 3.461,
    "open capitals": 0.981,
    "open few words": -1.619,
    "open function words": -1.838,
    "open market": 0.77,
    "open no function word": -0.517,
    "open one word": -2.168,
    "open repeats": 3.422,
    "open returns": 0.949,
    "open same words": 0.643,
    "open sells": 3.731,
    "open separated": -0.112,
    "open separators": -0.661,
    "open spaced semicolons": 3.769,
    "open words": -0.523,
    "partly linked": 4.257,
    "partly tagged": 3.019,
    "tagged": 0.031,
}
