"""Digests of the canonical forms of whole licence texts, with and without what follows their terms."""

DIGESTS = [
    ("Apache-2.0", "045649cdaf85384ba827242062f2f3b36409835c98d297e25177cb1faf7c2847"),
    ("Apache-2.0", "108490d21e2d3edc9128233e48fabc169818d0c7c5f0bbdd58231a367d2d6c87"),
    ("Apache-2.0", "6ed232a1aaf66db92997c53c056b853f2a64b9f74585489f71cbae1bb4d6d166"),
    ("Artistic-1.0", "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93"),
    ("BSD-3-Clause", "ab899150d08a3ccf837f742a20fbd8dd108031100312f3224aa5e2d14e0d60f1"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "66919c3537107c2c9f5219f6ba4c41fe9c0d7c14d885087e3db69494463a778e"),
    ("GFDL-1.3", "525fd4384869c81c4cbd264822942ae15202284aed28fb120ba01fc119dda9ff"),
    ("GPL-1.0", "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9"),
    ("GPL-1.0", "4575f8cf583cfe5694de121df7d28ae3c2043234ee2357a6bc38c20fc1856cf0"),
    ("GPL-1.0", "88c0d32b6685976f91edcbb228c50498a7324b47880b82b90b4b86377ca82e38"),
    ("GPL-2.0", "611467176757b44c5c63b6b18b9b61a9e3d7bd13d738d6dde1cdce99fb1f12ef"),
    ("GPL-2.0", "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0"),
    ("GPL-2.0", "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6"),
    ("GPL-3.0", "37c56603f4e31b2543cd5b0af6f397ee80a8395704359e942e53728d5c3a84ff"),
    ("GPL-3.0", "8d6520963763ecc73999a1e1b87eb733cd1a6bab5e41203a93110a6b847c5023"),
    ("GPL-3.0", "f261b435eb8567cdf85af2d75ff64fc410ffd6736a25e4e3decf53444c84954b"),
    ("LGPL-2.0", "3ea7beb964a4396aa5ad75de90dd58ff01913b237f397517e8563b7acf07d87c"),
    ("LGPL-2.0", "59a061c498ef1c6b3fd9ad6466d69d12b400f64b87cb827d62c381d3bc6aca88"),
    ("LGPL-2.0", "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389"),
    ("LGPL-2.1", "1f0770d1499d1ef2c69208a3369d7d9f7722ab5c39fbad959327bed318feb554"),
    ("LGPL-2.1", "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97"),
    ("LGPL-2.1", "9c2c2afdce244f7835e438f43966f864ce47d82ebd6316bbcb123927f3280e30"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
]
