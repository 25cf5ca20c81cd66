"""Documents of the sf0.1 test table whose kind was read off excerpts by hand: start of the SHA-1 of the text, by kind."""

CHECKED = {
    "prose": "183740551fe0fa4b 36891854d18c7f71 528f7644d0088115 ae058fd036a0743b bdfbd4d56e309b34 d6d8db190beac085 e53579c741b38d70 fd4c0133aac90799",
    "list": "08fdc6eb050f0082 17b21741997b3328 3bb8053b303d439b 6c10cb2315222072 7303e6eeaf157bfe 8ae071f09ab720a4 a438b977d36775ab a85da093128ca35f "
            "ecfbac00e84acd6e ef6c4a5ab525fe6c",
    "table": "275080b5a4c33d20 376e528b155fee40 3f339396b46331fd 50bbe520ded7d208 5cbd0a848a1a4344 99a0715f9fc14653 ae4d9c0bd9c8c8bb fcc3e92116a5b051",
    "junk": "048758afdf3a10ef 08ee3b737adc5c4c 12494997830bda83 19ee1499b66df123 1ad103fcaba2f699 4ea60377853e6d14 56a30fee7412c80d 70b5f665f71d3f88 "
            "7ce6df033e4177db 88478f7eb510b1a6 9267bbeb31075374 a249a31873415d42 a9e88aff6deb30c2 bb2c1d6435c9bc22 da3a83d50ff7f680 e657dcd0fd7738f2",
}
